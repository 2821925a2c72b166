"""Substring de-duplication: seed on winnowed anchors, extend both ways, keep maximal repeats.

Anchors are hashes of ``ANCHOR`` consecutive words that are minimal among the
``WINDOW - ANCHOR + 1`` hashes of some window; every window of ``WINDOW`` words holds one, and equal
windows hold equal ones.  Anchors that occur once are dropped by a join with the repeated
ones; what is left are the seeds.  Around each seed the match is extended to both sides:
every window of ``WINDOW`` words whose own anchor is a seed is hashed (96 bits), and the first occurrence
of each such window - by (id, text hash, start) - is found by aggregation.  All others also
start earlier; runs of them are the maximal repeats of ``WINDOW`` words or more, and their
words are removed.  No pairs of documents are formed, so a passage shared by n documents
costs n rows.

Texts equal as a whole are represented by the one with the smallest id; a later copy of a
text of at least ``WINDOW`` words is a repeat from end to end.

Defined cases: a null text has no words; its text stays null; a text shorter than ``WINDOW`` words is
left as it is; a null id comes after all others; rows equal in id and text are one document
and get the same result; rows with one id and different texts are ordered by the text hash;
an empty table gives an empty result.  Input columns named like an added column give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.tables import documents, text_key, with_fields, written
from regspark.llm.words import MULT, _ship_by_value, binary_list, member, sliding_min, window_hashes, word_hashes

WINDOW = 20
ANCHOR = 6
MULT2 = 0xD6E8FEB86659FD93
LAST_ID = (1 << 63) - 1
ROWS_OUT = 100_000


def anchors_of(h, window: int, anchor: int):
    """(hash of every anchor occurrence, anchor hash of every window) of one text."""
    import numpy as np
    g = window_hashes(h, anchor)
    span = window - anchor + 1
    least = sliding_min(g, span)
    if not len(least):
        return least, least
    pad = np.full(span - 1, ~np.uint64(0))
    most = ~sliding_min(np.concatenate([pad, ~least, pad]), span)
    return g[g == most], least


def _anchors(window: int, anchor: int):
    def run(column):
        import numpy as np
        import pyarrow as pa
        found = [anchors_of(word_hashes(d.split()), window, anchor)[0] for d in binary_list(column)]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.empty(0, np.uint64)
        return pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))
    return run


def longs(col) -> list:
    """A column of long arrays as numpy views, null: None."""
    import numpy as np
    values, offsets = col.values.to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    return [values[a:b] if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], col.is_valid().to_pylist())]


WINDOWS = "w1 long, w2 int, place binary"
PLACE = [("did", ">u8"), ("check", ">u4"), ("start", ">u4")]
SIGN = 1 << 63


def places(did, check, start):
    """Sortable 16-byte places (id, check, start) as an Arrow binary array."""
    import numpy as np
    import pyarrow as pa
    rows = np.empty(len(start), np.dtype(PLACE))
    rows["did"] = did.view(np.uint64) ^ np.uint64(SIGN)             # signed order as byte order
    rows["check"] = check.view(np.uint32) ^ np.uint32(1 << 31)
    rows["start"] = start
    offsets = np.arange(0, 16 * len(start) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _unplaced(column):
    """The fields of places."""
    import numpy as np
    import pyarrow as pa
    rows = np.frombuffer(b"".join(column.to_pylist()), np.dtype(PLACE))
    did = (rows["did"].astype(np.uint64) ^ np.uint64(SIGN)).view(np.int64)
    check = (rows["check"].astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)
    return pa.StructArray.from_arrays([pa.array(did), pa.array(check), pa.array(rows["start"].astype(np.int64))], ["did", "check", "start"])


def _windows(window: int, anchor: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        names = [f.split()[0] for f in WINDOWS.split(", ")]

        def batch_of(parts):
            w1, w2, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
            sizes = [len(p[0]) for p in parts]
            did, check = (np.repeat(np.array([p[i] for p in parts], t), sizes) for i, t in ((3, np.int64), (4, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.astype(np.uint32).view(np.int32)),
                                               places(did, check, start)], names)

        for batch in batches:
            parts, n = [], 0
            for data, seeds, did, check in zip(binary_list(batch["text"]), longs(batch["__seeds"]),
                                               batch["__did"].to_pylist(), batch["__check"].to_pylist()):
                if seeds is None or not len(seeds):
                    continue
                h = word_hashes(data.split())
                at = np.flatnonzero(member(anchors_of(h, window, anchor)[1], np.sort(seeds)))
                parts.append((window_hashes(h, window)[at], window_hashes(h, window, MULT2)[at] >> np.uint64(32), at, did, check))
                n += len(at)
                if n >= ROWS_OUT:
                    yield batch_of(parts)
                    parts, n = [], 0
            if parts:
                yield batch_of(parts)
    return run


def removed_words(h, seeds, first, window: int, anchor: int):
    """Mask of the words covered by windows that also start earlier."""
    import numpy as np
    mask = np.zeros(len(h), bool)
    if seeds is None or not len(seeds):
        return mask
    at = np.flatnonzero(member(anchors_of(h, window, anchor)[1], np.sort(seeds)))
    if first is not None and len(first):
        at = np.setdiff1d(at, first, assume_unique=True)
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def cut_text(data: bytes, mask) -> bytes:
    """The text without the masked words; the white space before a kept word stays."""
    import re
    out, kept = [], False
    end = 0
    for m, gone in zip(re.finditer(rb"[^\x20\x09-\x0d]+", data), mask.tolist()):
        if not gone:
            out.append(data[end:m.end()] if kept else data[m.start():m.end()])
            kept = True
        end = m.end()
    return b"".join(out)


FIELDS = "text string, n_words long, n_removed long, removed array<struct<start: int, stop: int>>"
NAMES = ["text", "n_words", "n_removed", "removed"]


def _remover(window: int, anchor: int):
    def run(texts, is_copy, seeds, firsts):
        import numpy as np
        import pyarrow as pa
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        cols = {n: [] for n in NAMES}
        null = texts.is_null().to_pylist()
        firsts = [None if f is None else f.view(np.int64) for f in longs(firsts)]
        for data, gone, copy, seed, first in zip(binary_list(texts), null, is_copy.to_pylist(), longs(seeds), firsts):
            words = data.split()
            if copy and len(words) >= window:
                mask = np.ones(len(words), bool)
            elif seed is None or not len(seed):
                mask = np.zeros(0, bool)
            else:
                mask = removed_words(word_hashes(words), seed, first, window, anchor)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            cols["text"].append(None if gone else (cut_text(data, mask) if mask.any() else data).decode("utf-8", "replace"))
            cols["n_words"].append(len(words))
            cols["n_removed"].append(int(mask.sum()))
            cols["removed"].append([{"start": int(a), "stop": int(b)} for a, b in zip(edges[::2], edges[1::2])])
        return pa.StructArray.from_arrays([
            pa.array(cols["text"], pa.string()), pa.array(cols["n_words"], pa.int64()),
            pa.array(cols["n_removed"], pa.int64()), pa.array(cols["removed"], pa.list_(span))], NAMES)
    return F.arrow_udf(run, FIELDS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every row of ``docs`` with its ``text`` less the repeated words, ``n_words``,
    ``n_removed`` and the removed word spans."""
    if not 1 <= anchor <= window:
        raise ValueError("1 <= anchor <= window")
    held = [c for c in docs.columns if c.lower() not in {*NAMES, "text"}]
    text = F.col("text").cast("string")
    base = docs.select(*[F.col(f"`{c}`") for c in held], text.alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("__did"), F.hash(text).alias("__check"))
    key = ["__did", "__check"]
    grams = F.arrow_udf(_anchors(window, anchor), "array<long>")
    # one row per document with its anchors, and what tells equal texts
    scan = written(base.select(*key, text_key(F.col("text")).alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
                               grams("text").alias("anchors")), "anchors")
    copies = (scan.groupBy("h1", "h2").agg(F.min("__did").alias("first_did"), F.max("__did").alias("last_did"))
              .where("last_did > first_did").drop("last_did"))
    copies = (scan.select(*key, "h1", "h2").join(copies, ["h1", "h2"]).where("__did > first_did")
              .select(*key, F.lit(True).alias("__copy")).distinct())
    repeated = (scan.select(F.explode("anchors").alias("a")).groupBy("a").agg(F.count("*").alias("n"))
                .where("n > 1").select("a"))
    seeds = (scan.select(*key, F.explode(F.array_distinct("anchors")).alias("a")).join(repeated, "a")
             .groupBy(*key).agg(F.collect_set("a").alias("__seeds")))
    seeded = base.join(copies, key, "left").join(seeds, key, "left")
    seeded = seeded.withColumn("__seeds", F.when(F.col("__copy"), F.lit(None)).otherwise(F.col("__seeds")))
    # all columns, as in the last join: both then read the same shuffled texts
    windows = seeded.mapInArrow(_windows(window, anchor), WINDOWS)
    firsts = (windows.groupBy("w1", "w2").agg(F.min("place").alias("place"))
              .select(F.arrow_udf(_unplaced, "did long, check int, start long")("place").alias("o"))
              .groupBy(F.col("o.did").alias("__did"), F.col("o.check").alias("__check"))
              .agg(F.collect_list("o.start").alias("__firsts")))
    done = seeded.join(firsts, key, "left")
    cut = _remover(window, anchor)("text", F.coalesce("__copy", F.lit(False)), "__seeds", "__firsts")
    return with_fields(done, cut, NAMES).drop("__did", "__check", "__copy", "__seeds", "__firsts")


def word_digest(text):
    """sha256 (hex) of the words joined by one space."""
    def run(column):
        import hashlib
        import pyarrow as pa
        return pa.array([hashlib.sha256(b" ".join(d.split())).hexdigest() for d in binary_list(column)], pa.string())
    return F.arrow_udf(run, "string")(text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of those kept."""
    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", word_digest(F.col("text")).alias("kept_sha256"))


_ship_by_value(__name__)
