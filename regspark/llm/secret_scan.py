"""Secret scan through a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression.  From its parse tree comes a Boolean trigram query: an OR
of ANDs of the trigrams (lower-cased) that every match must hold.  The index holds postings
(trigram, document) of the trigrams that some rule asks for.  A rule's candidates are the
documents whose postings fill one of its ANDs; only these are matched against the rule.  A
rule without mandatory trigrams is matched against every document.

``regexp_extract_all`` and ``split`` by the same expression give the leftmost matches, which do
not overlap, and the gaps between them; the running sum of their lengths gives the places in
code points.  Matches whose checked group is too short are dropped afterwards.

Defined cases: a null text counts as empty; an empty text has no matches; a text of any length
is scanned whole; spans with one start come in the order of the rules; rows equal in id and
text are matched once and each gets the spans; an empty table gives an empty result.  An input
column named ``spans`` is replaced, all others are kept.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.tables import documents, text_key, written


class Rule(NamedTuple):
    """``group`` of a match of ``pattern`` has ``least`` characters or more, else it is dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# The three base kinds, then those that are added to them.
BASE = [
    Rule("assign", "(" + any_case("password|passwd|secret|token|api_?key")
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),            # the runs of 16 and more among those of [0-9a-f]+
]
RULES = [
    *BASE,
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"""://[^\x20\x09-\x0D/:@"'<>]+:[^\x20\x09-\x0D/:@"'<>]+@"""),
]
#: alternatives kept while a query is derived; beyond them a part of the query is left out
ALTERNATIVES = 64

ANY = frozenset([frozenset()])                # the query that every text fulfils


def _least(clauses) -> frozenset:
    """``clauses`` without those that ask for all that another one asks for."""
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _both(a: frozenset, b: frozenset) -> frozenset:
    if len(a) * len(b) > ALTERNATIVES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _least({x | y for x, y in product(a, b)})


def _of_strings(strings) -> frozenset:
    return _least({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _characters(items) -> set | None:
    """The lower-cased characters of a class; None for a large or open one."""
    out = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            out.add(chr(value).lower())
        elif name == "RANGE" and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _derive(nodes) -> tuple[set | None, frozenset]:
    """(all strings that ``nodes`` match, or None if these are too many; their query)."""
    query, strings, whole = ANY, {""}, True
    for op, value in nodes:
        name, own, part = str(op), None, ANY
        if name == "LITERAL":
            own = {chr(value).lower()}
        elif name == "IN":
            own = _characters(value)
        elif name == "SUBPATTERN":
            own, part = _derive(value[3])
        elif name == "BRANCH":
            got = [_derive(v) for v in value[1]]
            own = set().union(*(g[0] for g in got)) if all(g[0] is not None for g in got) else None
            part = _least(frozenset().union(*(g[1] for g in got)))
        elif name == "MAX_REPEAT":
            low, high, what = value
            inner, asked = _derive(what)
            if low:
                part = asked
            if inner is not None and high <= 4:
                own = {"".join(p) for n in range(low, high + 1) for p in product(inner, repeat=n)}
        if own is not None and len(strings) * len(own) <= ALTERNATIVES:
            strings = {s + o for s, o in product(strings, own)}
            continue
        query, strings, whole = _both(_both(query, _of_strings(strings)), part), {""}, False
        if own is not None:
            strings = own if len(own) <= ALTERNATIVES else {""}
    return (strings if whole else None), _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> list[list[str]] | None:
    """An OR of ANDs of lower-cased trigrams that every match holds; None if there are none."""
    import re._parser as parser
    query = _derive(parser.parse(pattern))[1]
    return None if frozenset() in query else sorted(sorted(c) for c in query)


def trigram_postings(docs: DataFrame, trigrams: list[str], key: list[str], text: str = "text") -> DataFrame:
    """Index rows (trigram, *key), each once, of those ``trigrams`` that a text holds."""
    asked = F.array(*[F.lit(t) for t in sorted(trigrams)])
    # the lower-cased text is made once for all trigrams
    found = F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))),
                        lambda low: F.filter(asked, lambda t: F.contains(low, t)))[0]
    return docs.select(F.explode(found).alias("trigram"), *key).distinct()


def candidates(postings: DataFrame, queries: dict[str, list[list[str]]], key: list[str]) -> DataFrame:
    """(*key, kinds): the rules one of whose ANDs the postings of a document fill."""
    asked: dict[str, list[Column]] = {}
    for kind, clauses in queries.items():
        for i, clause in enumerate(clauses):
            for t in clause:
                asked.setdefault(t, []).append(
                    F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("clause"), F.lit(len(clause)).alias("size")))
    table = F.create_map(*[c for t, rows in sorted(asked.items()) for c in (F.lit(t), F.array(*rows))])
    rows = postings.select(*key, F.explode(table[F.col("trigram")]).alias("asked"))
    full = rows.groupBy(*key, "asked").agg(F.count(F.lit(1)).alias("held")).where("held = asked.size")
    return full.groupBy(*key).agg(F.collect_set("asked.kind").alias("__kinds"))


def _raw(rule: Rule, order: int, text: Column) -> Column:
    """Every match of a rule, in order: number, gap before it, its length, whether it passes."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits

    def rows(found):
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), (checked if rule.group else found).alias("part"))
        return F.when(F.size(found) > 0, F.transform(zipped, lambda x, i: F.struct(
            F.lit(order).alias("kind"), i.alias("no"), F.length(x["gap"]).cast("long").alias("gap"),
            F.length(x["hit"]).cast("long").alias("size"), (F.length(x["part"]) >= rule.least).alias("passes"))))
    return F.coalesce(F.transform(F.array(hits), rows)[0], F.array().cast(
        "array<struct<kind:int,no:int,gap:bigint,size:bigint,passes:boolean>>"))


def _matches(docs: DataFrame, rules: list[tuple[int, Rule]], key: list[str], text: Column, asked: Column | None = None) -> DataFrame:
    """Rows (*key, kind, no, gap, size, passes) of every match of ``rules``."""
    none = F.array().cast("array<struct<kind:int,no:int,gap:bigint,size:bigint,passes:boolean>>")
    found = [_raw(r, i, text) if asked is None else F.when(F.array_contains(asked, r.kind), _raw(r, i, text)).otherwise(none)
             for i, r in rules]
    return docs.select(*key, F.explode(F.concat(*found)).alias("__m")).select(*key, "__m.*")


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``spans``: array of (start, end, kind) in code points, end
    exclusive, by start and then in the order of ``rules``."""
    kept = [c for c in docs.columns if c.lower() != "spans"]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    key = ["__id", "__key"]
    keyed = docs.select(F.col(f"`{doc_id}`").alias("__id"), text_key(value).alias("__key"), value.alias("__text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    numbered = list(enumerate(rules))
    open_rules = [(i, r) for i, r in numbered if queries[r.kind] is None]
    closed = [(i, r) for i, r in numbered if queries[r.kind] is not None]
    parts = []
    if open_rules:
        parts.append(_matches(keyed, open_rules, key, F.col("__text")))
    if closed:
        asked = {r.kind: queries[r.kind] for _, r in closed}
        trigrams = sorted({t for q in asked.values() for clause in q for t in clause})
        postings = written(trigram_postings(keyed, trigrams, key, "__text"), "trigram-postings")
        found = candidates(postings, asked, key).select(F.col("__id").alias("__id2"), F.col("__key").alias("__key2"), "__kinds")
        same = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__key") == F.col("__key2"))
        parts.append(_matches(keyed.join(found, same), closed, key, F.col("__text"), F.col("__kinds")))
    if not parts:
        raise ValueError("no rules")
    # equal rows of a document that is there several times become one
    rows = reduce(DataFrame.unionByName, parts).distinct()
    upto = Window.partitionBy(*key, "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto)).where("passes")
    span = F.struct((F.col("stop") - F.col("size")).alias("start"), F.col("kind").alias("no"), F.col("stop").alias("end"))
    per_doc = (placed.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("__spans"))
               .select(F.col("__id").alias("__id2"), F.col("__key").alias("__key2"),
                       F.transform("__spans", lambda s: F.struct(s["start"], s["end"], F.get(kinds, s["no"]).alias("kind")))
                       .alias("spans")))
    left = docs.select(*[F.col(f"`{c}`") for c in kept], text_key(value).alias("__key"))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("__id2")) & (F.col("__key") == F.col("__key2"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return left.join(per_doc, same, "left").select(*[F.col(f"`{c}`") for c in kept], F.coalesce("spans", empty).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(*kinds: str) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, all spans."""
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    base = [r.kind for r in BASE]
    counts = [F.size(of_kinds(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined_spans(of_kinds(*base)), 256).alias("base_sha256"),
                        joined_spans(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Every rule over every text, in SQL."""
    parts = []
    for i, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"select rid, {i} as no, '{r.kind}' as kind, {r.least} as least, regexp_split_to_array(t, {p}) as gaps, "
                     f"regexp_extract_all(t, {p}, 0) as hits, regexp_extract_all(t, {p}, {r.group}) as parts from docs")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"coalesce(count(*) filter (kind = '{r.kind}'), 0) as n_{r.kind}" for r in BASE)
    shown = "concat(kind, ':', start_at, ':', stop)"
    return f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as ({" union all ".join(parts)}),
hit as (select rid, no, kind, least, gaps, hits, parts, unnest(generate_series(1, len(hits))) as k from found where len(hits) > 0),
placed as (select rid, no, kind, length(parts[k]) >= least as passes, length(hits[k]) as size,
  sum(length(gaps[k]) + length(hits[k])) over (partition by rid, no order by k rows unbounded preceding)::bigint as stop from hit),
span as (select rid, no, kind, stop - size as start_at, stop from placed where passes),
per_doc as (select rid, {counts},
  coalesce(string_agg({shown}, ',' order by start_at, no) filter (kind in ({base})), '') as base_spans,
  string_agg({shown}, ',' order by start_at, no) as spans from span group by rid)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in BASE)},
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per_doc using (rid)"""


OP12_SQL = _sql()
