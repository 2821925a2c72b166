"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search.

Every benchmark item gets a fingerprint of ``BITS`` bits over its word shingles (words
lower-cased A-Z; five words a shingle, a shorter item is one shingle; a shingle counts as
often as it occurs, each occurrence in a window with its own bits, so that the fingerprint
follows the same weighted similarity).  A text is read in windows as long as the item.  Fingerprints are cut
into blocks; two fingerprints within ``RADIUS`` differ by at most ``RADIUS // blocks`` bits
in some block, so looking up every block value within that many bits misses none of them.
Candidates within the radius are then verified by the exact weighted similarity
sum(min) / sum(max) over shingle counts.

A window can only reach the similarity if it holds a shingle of the item, so windows are
laid only where the text has a shingle of an item of that length: nothing is lost by it.
The benchmark goes to the tasks in slices of at most ``SLICE_BYTES`` of text; every slice is
matched against every document.

Defined cases: null and empty texts and items match nothing; a text shorter than an item is
one window; an item found several times in a document is reported once, at its best window
(ties: the first); repeated document rows and repeated items are reported for each distinct
(id, text); empty tables give an empty result.  Input columns other than id and text are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.tables import documents, text_key
from regspark.llm.words import _ship_by_value, binary_list, member, mix, window_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BITS = 256
BLOCKS = 32
# similarity 0.8 turns 15 % of the bits on average (39 of 256, deviation 6): six deviations more
RADIUS = 73
SLICE_BYTES = 8 << 20

SCHEMA = ("doc_id long, doc_key long, item_id long, start_word long, n_words long, similarity double, "
          "hamming int")


def hashed_words(data: bytes):
    return word_hashes(data.lower().split())


def bit_signs(h):
    """(n, BITS) array of +1 / -1: the hash bits of every shingle."""
    import numpy as np
    salts = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    words = mix(h[:, None] ^ salts[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(h), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def ranked(h, ranks):
    """Hashes of shingles that each have ``ranks`` equal ones before them; rank 0 is the shingle's own."""
    import numpy as np
    return h + ranks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def fingerprints(h, starts, size: int):
    """Packed SimHash of ``h[s:s + size]`` for each start."""
    import numpy as np
    lo, hi = int(starts.min()), int(starts.max()) + size
    h, at = h[lo:hi], starts - lo
    kinds, which = np.unique(h, return_inverse=True)
    if len(kinds) == len(h):
        come = left = running(bit_signs(h))
    else:
        # window by window, a shingle comes as the last of its equals and leaves their count less by one
        places = np.arange(len(h))
        base = which.reshape(-1).astype(np.int64) * (len(h) + size)
        order = np.sort(base + places)
        own = np.searchsorted(order, base + places)
        before = own - np.searchsorted(order, base + np.maximum(places - size + 1, 0))
        after = np.searchsorted(order, base + places + size) - own - 1
        come, left = running(bit_signs(ranked(h, before))), running(bit_signs(ranked(h, after)))
    return np.packbits(come[at + size] - left[at] > 0, axis=1)


def running(signs):
    """Sums of the first 0, 1, 2, ... rows."""
    import numpy as np
    sums = np.zeros((len(signs) + 1, BITS), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    return sums


def block_tables(prints):
    """Per block: [value, item] -> may the item lie within the radius by this block?"""
    import numpy as np
    allowed = RADIUS // BLOCKS
    ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
    values = np.arange(256, dtype=np.uint8)
    return [ones[values[:, None] ^ prints[None, :, b]] <= allowed for b in range(BLOCKS)]


def candidates(prints, index, items):
    """(window, item, distance) of all pairs of fingerprints within the radius."""
    import numpy as np
    near = np.zeros((len(prints), len(items)), bool)
    for b, table in enumerate(index):
        near |= table[prints[:, b]]
    w, i = np.nonzero(near)
    distance = np.unpackbits(prints[w] ^ items[i], axis=1).sum(axis=1)
    fit = distance <= RADIUS
    return w[fit], i[fit], distance[fit]


def similarity(a, b) -> float:
    """sum(min) / sum(max) of shingle counts."""
    from collections import Counter
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum(min(n, y[s]) for s, n in x.items() if s in y)
    return both / (len(a) + len(b) - both)


class Items:
    """One slice of the benchmark, indexed by shingle length and item size."""

    def __init__(self, rows: list):
        import numpy as np
        self.groups = {}
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            h = hashed_words(text.encode())
            if not len(h):
                continue
            k = min(SHINGLE, len(h))
            self.groups.setdefault((k, len(h)), []).append((item_id, window_hashes(h, k)))
        self.by_k = {}
        for (k, n), items in self.groups.items():
            self.by_k.setdefault(k, {})[n] = (np.unique(np.concatenate([s for _, s in items])), items)
        self.gate = {}
        for k, sizes in self.by_k.items():
            every = np.unique(np.concatenate([s for s, _ in sizes.values()]))
            table = np.zeros(1 << 18, bool)
            table[(every & np.uint64(table.size - 1)).astype(np.int64)] = True
            self.gate[k] = (table, every)
        self.index = {}

    def search_index(self, k: int, n: int):
        """Fingerprints and block tables of the items of one size, made when first asked for."""
        import numpy as np
        if (k, n) not in self.index:
            items = self.by_k[k][n][1]
            prints = np.concatenate([fingerprints(s, np.zeros(1, np.int64), len(s)) for _, s in items])
            self.index[k, n] = (prints, block_tables(prints))
        return self.index[k, n]

    def matches(self, h):
        """(item_id, start, words, similarity, hamming): best window of each item in one text."""
        import numpy as np
        best = {}
        for k, (table, every) in self.gate.items():
            s = window_hashes(h, min(k, len(h)))
            at = np.flatnonzero(table[(s & np.uint64(table.size - 1)).astype(np.int64)])
            at = at[member(s[at], every)]
            if not len(at):
                continue
            for n, (shingles, items) in self.by_k[k].items():
                hits = at[member(s[at], shingles)]
                if not len(hits):
                    continue
                size = min(n - k + 1, len(s))
                cover = np.zeros(len(s) + 1, np.int32)
                np.add.at(cover, np.maximum(hits - size + 1, 0), 1)
                np.add.at(cover, hits + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                starts = starts[starts <= len(s) - size]
                if not len(starts):
                    continue
                prints, index = self.search_index(k, n)
                # a block of starts close together, so that memory stays bounded
                for part in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * n) + 1):
                    for lo in range(0, len(part), 4096):
                        block = part[lo:lo + 4096]
                        w, i, d = candidates(fingerprints(s, block, size), index, prints)
                        for a, b, dist in zip(w.tolist(), i.tolist(), d.tolist()):
                            start = int(block[a])
                            sim = similarity(s[start:start + size], items[b][1])
                            key = (k, n, b)
                            if sim >= SIMILARITY and (key not in best or sim > best[key][3]):
                                best[key] = (items[b][0], start, min(n, len(h)), sim, dist)
        return list(best.values())


def _matcher(rows: list):
    def run(batches):
        import pyarrow as pa
        items = Items(rows)
        for batch in batches:
            out = []
            for doc_id, key, data in zip(batch["doc_id"].to_pylist(), batch["doc_key"].to_pylist(),
                                         binary_list(batch["text"])):
                h = hashed_words(data)
                if len(h):
                    out += [(doc_id, key, *m) for m in items.matches(h)]
            cols = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             [f.split()[0] for f in SCHEMA.split(", ")])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per (document, benchmark item) whose similarity is ``SIMILARITY`` or more.

    ``doc_key`` is a hash of the text: it tells documents with the same id apart.
    """
    bench = (benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
             .where("text is not null").distinct())
    size = bench.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("doc_key"),
                       F.col("text").cast("string").alias("text")).where("text is not null")
    found = None
    for i in range(slices):
        part = bench if slices == 1 else bench.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == i)
        rows = [(r[0], r[1]) for r in part.collect()]           # at most about slice_bytes
        hits = slim.mapInArrow(_matcher(rows), SCHEMA)
        found = hits if found is None else found.unionByName(hits)
    return found


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated documents with the benchmark items that they hold."""
    bench = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), bench).drop("doc_key")


_ship_by_value(__name__)
