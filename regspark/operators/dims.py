"""Dimension tables: bounded broadcast lookups and segment counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.schemas import DIMENSION_NAMES

DEFAULT_MAX_BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast-hint ``df`` only if the plan's statistics (file sizes) bound it by ``max_bytes``.

    No job runs.  Beyond the bound the frame is returned unhinted; it joins by shuffle unless AQE
    measures it to be small.
    """
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return F.broadcast(df) if int(str(stats.sizeInBytes())) <= max_bytes else df


def lookup(df: DataFrame, dim: DataFrame, code_col: str, out_col: str | None = None,
           dim_code: str = "code", dim_desc: str = "description",
           max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
           columns: dict[str, str] | None = None) -> DataFrame:
    """Left-join descriptions for ``code_col``; unmatched codes keep nulls.

    ``columns`` maps several dimension columns to output names (one join for all of
    them); otherwise ``dim_desc`` becomes ``out_col``.
    """
    columns = columns or {dim_desc: out_col}
    d = bounded_broadcast(dim.select(F.col(dim_code).alias("__code"),
                                     *[F.col(k).alias(v) for k, v in columns.items()]), max_bytes)
    return df.join(d, df[code_col] == d["__code"], "left").drop("__code")


def lookup_dimensions(df: DataFrame, mapping: dict[str, tuple[DataFrame, str]], **kw) -> DataFrame:
    """Resolve several coded columns: ``{code_col: (dimension_df, out_col)}``."""
    for code_col, (dim, out_col) in mapping.items():
        df = lookup(df, dim, code_col, out_col, **kw)
    return df


# --- fixed values: CNAE 2.0 sections by two-digit division (lo, hi, section) ----------
CNAE_SECTIONS = [
    (1, 3, "A"), (5, 9, "B"), (10, 33, "C"), (35, 35, "D"), (36, 39, "E"), (41, 43, "F"),
    (45, 47, "G"), (49, 53, "H"), (55, 56, "I"), (58, 63, "J"), (64, 66, "K"), (68, 68, "L"),
    (69, 75, "M"), (77, 82, "N"), (84, 84, "O"), (85, 85, "P"), (86, 88, "Q"), (90, 93, "R"),
    (94, 96, "S"), (97, 97, "T"), (99, 99, "U"),
]
# ---------------------------------------------------------------------------------------


def segment_of(code: Column | str, rules: list[tuple[int, int, str]] = CNAE_SECTIONS,
               digits: int = 2) -> Column:
    """Segment of an activity code from its leading ``digits`` (a CASE chain, no join)."""
    c = F.col(code) if isinstance(code, str) else code
    div = F.substring(F.lpad(c.cast("string"), 7, "0"), 1, digits).try_cast("int")
    expr = None
    for lo, hi, seg in rules:
        cond = div.between(lo, hi)
        expr = F.when(cond, F.lit(seg)) if expr is None else expr.when(cond, F.lit(seg))
    return expr.otherwise(F.lit(None).cast("string"))


def section_rules(spark, sections: list[tuple[int, int, str]] = CNAE_SECTIONS) -> DataFrame:
    """The sections as a rule table ``(prefix, segment)``: a row for every two-digit division."""
    return spark.createDataFrame([(f"{d:02d}", s) for lo, hi, s in sections for d in range(lo, hi + 1)], "prefix string, segment string")


def segment_by_rules(df: DataFrame, rules: DataFrame, code_col: str, out_col: str = "segment",
                     prefix_col: str = "prefix", segment_col: str = "segment", level_col: str | None = None) -> DataFrame:
    """Add the segment of the longest rule prefix that a hierarchical code starts with.

    ``rules`` may hold prefixes of any length; of several rules with one prefix the least segment
    counts.  One equi-join over the prefixes of the distinct codes, for the lengths that the rules
    have; ``level_col`` adds the length of the prefix that won.  No rule: nulls.  A rule with an
    empty prefix is the default of all codes that are not null."""
    r = (rules.where(F.col(prefix_col).isNotNull()).groupBy(F.col(prefix_col).alias("__prefix"))
         .agg(F.min(segment_col).alias("__segment")))
    lengths = sorted(x[0] for x in r.select(F.length("__prefix")).distinct().collect())       # the levels of the hierarchy
    code = F.col(f"`{code_col}`").cast("string")
    codes = df.select(code.alias("__code")).where("__code is not null").distinct()
    prefixes = F.array(*[F.when(F.length("__code") >= n, F.substring("__code", 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    hits = codes.select("__code", F.explode(F.array_compact(prefixes)).alias("__prefix")).join(r, "__prefix")
    best = hits.groupBy("__code").agg(F.max_by("__segment", F.length("__prefix")).alias(out_col),
                                      *([F.max(F.length("__prefix")).alias(level_col)] if level_col else []))
    return df.join(best, code == F.col("__code"), "left").drop("__code")


def segment_level_counts(df: DataFrame, rules: DataFrame, code_col: str, **kw) -> DataFrame:
    """Rows per level of the rule that decided (null: none) and segment."""
    return segment_by_rules(df, rules, code_col, level_col="level", **kw).groupBy("level", "segment").agg(F.count(F.lit(1)).alias("n"))


def segment_counts(df: DataFrame, by: list[str], distinct_col: str | None = None) -> DataFrame:
    """Companies per segment: ``count(*)`` and optionally ``count(distinct distinct_col)``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if distinct_col:
        aggs.append(F.countDistinct(distinct_col).alias("k"))
    return df.groupBy(*by).agg(*aggs)


# --- fixed values: which dimension resolves which column of the joined registry table --
CODE_DIMENSIONS = {
    "cnae": "Cnaes", "mot_sit_cad": "Motivos", "municipio": "Municipios", "nat_jur_emp": "Naturezas",
    "pais": "Paises", "pais_soc": "Paises", "qual_resp_emp": "Qualificacoes", "qual_soc": "Qualificacoes",
    "qual_rep": "Qualificacoes",
}
# columns that hold several codes, separated by commas
CODE_LIST_DIMENSIONS = {"cnae_2": "Cnaes"}
# ----------------------------------------------------------------------------------------


def load_dimensions(spark, root: str, names: list[str] = DIMENSION_NAMES, snapshot: str | list[str] = "*",
                    dialect=None, optional: bool = False) -> dict[str, DataFrame]:
    """The dimensions found by name (any case) under ``root``: ``{name: (code, description)}``.

    A code that several snapshots describe keeps the description of the latest one.
    """
    from regspark.schemas import DIMENSION_SCHEMA, REGISTRY
    from regspark.sources.shards import scan_shards
    out = {}
    for name in names:
        got = scan_shards(spark, root, name, DIMENSION_SCHEMA, dialect or REGISTRY, snapshot, optional=optional)
        out[name] = got.groupBy("code").agg(F.max_by("description", F.struct("snapshot", "description")).alias("description"))
    return out


def lookup_list(df: DataFrame, dim: DataFrame, list_col: str, out_col: str, sep: str = ",",
                dim_code: str = "code", dim_desc: str = "description",
                max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Add ``out_col``: the descriptions (array, in order; null for an unknown code) of the codes
    in ``list_col``, separated by ``sep``.  A null or empty list has a null result.

    Every distinct list is resolved once; rows meet its result in an equi-join."""
    codes = F.transform(F.split(F.col("__list"), F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E"))), lambda c: F.trim(c))
    lists = df.select(F.col(f"`{list_col}`").alias("__list")).where("trim(__list) <> ''").distinct()
    parts = lists.select("__list", F.posexplode(codes).alias("__pos", "__one"))
    named = lookup(parts, dim, "__one", "__desc", dim_code, dim_desc, max_bytes)
    whole = (named.groupBy("__list").agg(F.array_sort(F.collect_list(F.struct("__pos", "__desc"))).alias("__all"))
             .select("__list", F.col("__all.__desc").alias(out_col)))
    return df.join(whole, F.col(f"`{list_col}`") == F.col("__list"), "left").drop("__list")


def resolve_codes(df: DataFrame, dimensions: dict[str, DataFrame], codes: dict[str, str] = CODE_DIMENSIONS,
                  suffix: str = "_desc", lists: dict[str, str] = CODE_LIST_DIMENSIONS) -> DataFrame:
    """Add ``<column>_desc`` for every coded column that ``df`` has and a dimension resolves; a
    column of code lists gets an array of descriptions."""
    out = lookup_dimensions(df, {c: (dimensions[d], c + suffix) for c, d in codes.items()
                                 if c in df.columns and d in dimensions})
    for c, d in lists.items():
        if c in df.columns and d in dimensions:
            out = lookup_list(out, dimensions[d], c, c + suffix)
    return out


def load_dimension(spark, paths, dialect=None) -> DataFrame:
    """A dimension file as ``(code, description)`` strings (headerless ``;`` text)."""
    from regspark.schemas import DIMENSION_SCHEMA, REGISTRY
    from regspark.sources.delimited import read_delimited
    return read_delimited(spark, paths, DIMENSION_SCHEMA, dialect or REGISTRY)
