"""Sharding by sampled splitters: near equal bytes per shard, equal texts side by side.

Records are ordered by (hash of the text, hash of id and text).  Keys are drawn with a
chance in proportion to the record's size; the quantiles of the draw are the splitters of
many small ranges.  Ranges that turn out overfull are drawn from again and subdivided, down
to single keys, so a text copied into a third of all rows is spread over many ranges.  The
sizes of the ranges, and running sums inside each, give the exact byte position of every
record, and so the cut keys between shards.  A group of equal texts of at most
``GROUP_SHARE`` of a shard is never cut.  Records are then range-partitioned by
all splitters and numbered in order.

What reaches the driver: the drawn keys (about ``DRAWS`` for each range), one total for each
range and one cut for each shard.

Defined cases: a null text counts as empty and, like an empty one, has size 8; a null id is a
key like any other; rows equal in id and text cannot be told apart, stay together and share
an order; an empty table gives an empty result.  Input columns named like an output column
are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regspark.llm.tables import documents, text_key, with_fields, written
from regspark.llm.words import _ship_by_value

SHARDS = 24
RANGES_PER_SHARD = 16
RANGE_BYTES = 1 << 30
DRAWS = 32
OVERFULL = 2.0
GROUP_SHARE = 0.01


def _ranger(first: list, second: list, values: list):
    """UDF (k1, k2) -> the values of the range that the key falls into."""
    def run(a, b):
        import numpy as np
        import pyarrow as pa
        k1, k2 = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
        s1, s2 = np.array(first, np.int64), np.array(second, np.int64)
        at, upto = np.searchsorted(s1, k1, "left"), np.searchsorted(s1, k1, "right")
        inside = np.flatnonzero(at < upto)
        for key in np.unique(k1[inside]):
            own = inside[k1[inside] == key]
            lo, hi = at[own[0]], upto[own[0]]
            at[own] = lo + np.searchsorted(s2[lo:hi], k2[own], "right")
        names = [n for n, _ in values]
        return pa.StructArray.from_arrays([pa.array(at, pa.int64())] + [
            pa.array(np.asarray(v, np.int64)[at], pa.int64()) for _, v in values], ["range_no", *names])
    return F.arrow_udf(run, "range_no long" + "".join(f", {n} long" for n, _ in values))


def _in_ranges(keys: DataFrame, cuts: list, **values) -> DataFrame:
    udf = _ranger([c[0] for c in cuts], [c[1] for c in cuts], list(values.items()))
    return with_fields(keys, udf("k1", "k2"), ["range_no", *values])


def _draw(keys: DataFrame, bytes_per_draw: float, seed: int) -> list:
    """Keys drawn with a chance in proportion to their size (certain from bytes_per_draw on)."""
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    got = keys.where(u < F.col("size") / bytes_per_draw).select("k1", "k2", "size").distinct().collect()
    return sorted((r[0], r[1], max(1.0, r[2] / bytes_per_draw)) for r in got)


def _quantiles(drawn: list, n: int) -> list:
    """``n - 1`` keys that cut the weighted draw into ``n`` near equal parts."""
    total, cuts, done = sum(d[2] for d in drawn), [], 0.0
    for k1, k2, weight in drawn:
        if done > 0 and done >= (len(cuts) + 1) * total / n and (not cuts or cuts[-1] != (k1, k2)):
            cuts.append((k1, k2))
        done += weight
    return cuts


def _sums(keys: DataFrame, cuts: list) -> dict:
    rows = (_in_ranges(keys, cuts).groupBy("range_no")
            .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"),
                 F.min("k1").alias("lo1"), F.max("k1").alias("hi1"),
                 F.min("k2").alias("lo2"), F.max("k2").alias("hi2")).collect())
    return {r["range_no"]: r for r in rows}


def splitters(keys: DataFrame, total: int, n_ranges: int) -> tuple[list, dict]:
    """Range cuts such that no divisible range is overfull, and the totals of the ranges."""
    target = total / n_ranges
    cuts = _quantiles(_draw(keys, target / DRAWS, 0), n_ranges)
    seed = 0
    while True:
        sums = _sums(keys, cuts)
        over = {i: s for i, s in sums.items()
                if s["bytes"] > OVERFULL * target and s["n"] > 1 and (s["lo1"], s["lo2"]) != (s["hi1"], s["hi2"])}
        if not over or seed >= 16:
            return cuts, sums
        seed += 1
        drawn = _draw(_in_ranges(keys, cuts).where(F.col("range_no").isin(list(over))), target / DRAWS / 2 ** seed, seed)
        by_range: dict[int, list] = {}
        for d in drawn:
            by_range.setdefault(_place(cuts, d[:2]), []).append(d)
        new = set()
        for i, part in by_range.items():
            new.update(_quantiles(part, 1 + int(over[i]["bytes"] / target)) if i in over else [])
        if not new - set(cuts):
            return cuts, sums
        cuts = sorted(set(cuts) | new)


def _place(cuts: list, key: tuple) -> int:
    from bisect import bisect_right
    return bisect_right(cuts, key)


def _offsets(sums: dict, n: int, field: str) -> list:
    out, done = [], 0
    for i in range(n):
        out.append(done)
        done += sums[i][field] if i in sums else 0
    return out


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` range-partitioned, with ``size``, ``shard`` and gapless ``slot`` in the shard."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size = (F.octet_length(raw) + 8).cast("long")
    k1 = text_key(F.col(text).cast("string"))
    k2 = F.xxhash64(F.col(doc_id), k1, F.lit(7))
    keys = written(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0]
    out = ["k1", "k2", "size", "range_no", "shard", "slot"]
    if not total:
        return with_fields(docs, F.struct(size.alias("size"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")),
                           ["size", "shard", "slot"])
    cuts, sums = splitters(keys, total, max(n_shards * RANGES_PER_SHARD, total // RANGE_BYTES))
    # exact byte positions, and by them the first key of every shard
    placed = _in_ranges(keys, cuts, before=_offsets(sums, len(cuts) + 1, "bytes"))
    order = W.partitionBy("range_no").orderBy("k1", "k2").rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy("range_no", "k1")
    placed = (placed.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
              .withColumn("g_bytes", F.sum("size").over(group)).withColumn("g_start", F.min("start").over(group)))
    whole = F.col("g_bytes") <= GROUP_SHARE * total / n_shards
    middle = F.when(whole, F.col("g_start") + F.col("g_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
    shard = F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int")
    first = (placed.select(shard.alias("shard"), F.struct("k1", "k2").alias("key"))
             .groupBy("shard").agg(F.min("key").alias("key")).orderBy("key").collect())
    starts = {tuple(r["key"]): r["shard"] for r in first}
    cuts = sorted(set(cuts) | set(starts))
    # the shard of every range, and the rows of its shard before it
    sums = _sums(keys, cuts)
    shards, rows_before, now, done = [], [], first[0]["shard"], 0
    for i in range(len(cuts) + 1):
        if i and cuts[i - 1] in starts and starts[cuts[i - 1]] != now:
            now, done = starts[cuts[i - 1]], 0
        shards.append(now)
        rows_before.append(done)
        done += sums[i]["n"] if i in sums else 0
    held = [c for c in docs.columns if c.lower() not in out]
    moved = _in_ranges(docs.select(*[F.col(f"`{c}`") for c in held], k1.alias("k1"), k2.alias("k2"), size.alias("size")),
                       cuts, shard=shards, rows_before=rows_before)
    rank = F.row_number().over(W.partitionBy("range_no").orderBy("k1", "k2"))
    return moved.select(*[F.col(f"`{c}`") for c in held], "size", F.col("shard").cast("int").alias("shard"),
                        (F.col("rows_before") + rank - 1).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law ``bytes``."""
    shards = assign_shards(documents(spark, sf_dir).select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return shards.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


_ship_by_value(__name__)
