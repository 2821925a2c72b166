"""Registry joins: exact name join (N:M) and left join on a key prefix (N:M).

Both are equi-joins on expressions, so Catalyst plans them as shuffled hash / sort-merge
joins (or broadcast when a side is provably small) keyed on the expression, never as a
nested loop.  AQE's skew handling splits oversized partitions of the *streamed* side.
What it cannot split is a hot key on the right side of a left outer join (one prefix
that owns a third of all partners).  :func:`equi_join` handles that case explicitly:
keys whose right-side row count exceeds ``hot_rows`` are salted — their right rows are
spread over as many buckets as their count asks for and the matching left rows are
copied once per bucket — so no single task receives the whole hot group.  The result is
exactly the plain join's result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.keys import prefix_key

_LK, _RK, _SALT = "__join_key_l", "__join_key_r", "__join_salt"


def rename_collisions(left: DataFrame, right: DataFrame, suffix: str = "_r") -> DataFrame:
    """Rename columns of ``right`` that also exist in ``left`` by appending ``suffix``.

    The joined frame then has unique names, so it can be written to Parquet and columns
    can be selected by name (``pais`` exists in both establishments and partners).
    """
    taken = set(left.columns)
    out = []
    for c in right.columns:
        name = c
        while name in taken:
            name = name + suffix
        taken.add(name)
        out.append(F.col(f"`{c}`").alias(name))
    return right.select(*out)


def hot_key_frame(source: DataFrame, key: Column, hot_rows: int, name: str = "__hot_key") -> DataFrame:
    """Keys owning more than ``hot_rows`` rows of ``source``, with a bucket count each.

    ``buckets = ceil(rows / hot_rows)``, so a salted bucket holds about ``hot_rows`` right rows
    whatever the key's size.  Map-side partial counting keeps the shuffle at one row per key
    and task.  The frame has at most ``rows / hot_rows`` rows.
    """
    counts = source.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("__n")) \
        .where(F.col(name).isNotNull() & (F.col("__n") > hot_rows))
    return counts.select(name, F.ceil(F.col("__n") / F.lit(hot_rows)).cast("int").alias("__buckets"))


def equi_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column,
              how: str = "inner", *, hot_rows: int | None = None) -> DataFrame:
    """``left ⋈ right`` on ``left_key == right_key`` for ``how`` in inner / left.

    Output columns: all of ``left`` then all of ``right``.  No job runs before the caller's.

    With ``hot_rows`` set, right-side keys with more rows than that are salted over
    ``b = ceil(rows / hot_rows)`` buckets.  Both sides look ``b`` up by joining the frame of hot
    keys, which is small (``rows / hot_rows`` rows at most), so AQE broadcasts it by its measured
    size; a hot right row goes to bucket ``hash(row, partition) mod b`` (a retried task
    rebuilds the same buckets, and equal rows from different tasks spread), a hot left row
    is copied into each of the ``b`` buckets, cold rows use bucket 0, and the join runs on
    ``(key, bucket)``.  For a left join, the null-padded copies of hot left rows are dropped:
    every hot key has right rows, so each hot row still meets all of them exactly once.
    """
    if how not in ("inner", "left", "left_outer"):
        raise ValueError(f"unsupported join type {how!r}")
    if hot_rows is not None and hot_rows < 1:
        raise ValueError("hot_rows must be positive")
    # positional temp names: both sides may share column names, and the hot-key frame
    # derives from the right side, so nothing below relies on DataFrame-bound columns
    ln = [f"__l{i}" for i in range(len(left.columns))]
    rn = [f"__r{i}" for i in range(len(right.columns))]
    l = left.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(left.columns, ln)], left_key.alias(_LK))
    r = right.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(right.columns, rn)], right_key.alias(_RK))
    out_cols = ([F.col(n).alias(c) for c, n in zip(left.columns, ln)]
                + [F.col(n).alias(c) for c, n in zip(right.columns, rn)])
    if hot_rows is None:
        return l.join(r, F.col(_LK) == F.col(_RK), how).select(*out_cols)
    hot = hot_key_frame(right, right_key, hot_rows)
    hot_l = hot.select(F.col("__hot_key").alias("__hk_l"), F.col("__buckets").alias("__b_l"))
    hot_r = hot.select(F.col("__hot_key").alias("__hk_r"), F.col("__buckets").alias("__b_r"))
    lb = l.join(hot_l, F.col(_LK) == F.col("__hk_l"), "left")
    lt = lb.select(*ln, _LK, F.col("__b_l").isNotNull().alias("__hot_l"), F.explode(
        F.sequence(F.lit(0), F.coalesce(F.col("__b_l"), F.lit(1)) - 1)).alias(_SALT))
    row_hash = F.xxhash64(*[F.col(n) for n in rn], F.col("__part"))
    rb = r.withColumn("__part", F.spark_partition_id()).join(hot_r, F.col(_RK) == F.col("__hk_r"), "left")
    rt = rb.select(*rn, _RK, F.when(F.col("__b_r").isNotNull(), F.pmod(row_hash, F.col("__b_r")).cast("int"))
                   .otherwise(F.lit(0)).alias(_SALT + "_r"))
    j = lt.join(rt, (F.col(_LK) == F.col(_RK)) & (F.col(_SALT) == F.col(_SALT + "_r")), how)
    if how != "inner":
        j = j.where(~(F.col("__hot_l") & F.col(_RK).isNull()))
    return j.select(*out_cols)


def name_join(left: DataFrame, right: DataFrame, left_col: str = "razao_emp",
              right_col: str = "fantasia", how: str = "inner", normalize: bool = False,
              **skew) -> DataFrame:
    """Companies ⋈ establishments on an exact name (case and spaces significant).

    ``normalize=True`` compares ``upper(trim(name))`` instead (opt-in).
    """
    lk, rk = F.col(left_col), F.col(right_col)
    if normalize:
        lk, rk = F.upper(F.trim(lk)), F.upper(F.trim(rk))
    return equi_join(left, right, lk, rk, how, **skew)


def prefix_left_join(left: DataFrame, right: DataFrame, left_col: str = "cnpj",
                     right_col: str = "cnpj_soc", length: int = 7, width: int | None = None,
                     how: str = "left", **skew) -> DataFrame:
    """``left ⟕ right`` on the first ``length`` characters of both keys (N:M)."""
    return equi_join(left, right, prefix_key(left_col, length, width),
                     prefix_key(right_col, length, width), how, **skew)
