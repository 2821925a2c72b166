"""Best-fit packing with exact complements.

A document becomes its token ids and one id 0; only a longer one is cut, into pieces of
``CAPACITY`` ids.  What is to be packed is fully described by how many pieces there are of
each length, a table of at most ``CAPACITY`` rows whatever the corpus.  The plan is made on it:
a sequence starts with the longest piece left; its gap is filled exactly by one piece, or
by a pair or triple whose lengths sum to the gap, if they are available; otherwise the best
fitting (longest) piece goes in and the smaller gap is tried again.  A pattern found is used as often
as the availability counts allow, so each use exhausts some length and the plan stays small.

Every piece then finds its place by its rank among the pieces of its length: the rank inside
the task that cut it plus the count of earlier tasks.

Defined cases: a null or empty text is the single id 0; rows repeated in the input are packed
each on their own; a null id is carried along; an empty table gives an empty result.  Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regspark.llm.tables import documents, text_key, written
from regspark.llm.words import _ship_by_value, binary_list, worker_store

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: words, and pieces of words, that a worker keeps in each of two generations
CACHED_WORDS, CACHED_PIECES = 200_000, 150_000

PIECES = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_letters() -> dict:
    """The character that byte-level vocabularies write for each byte: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Recent(dict):
    """A cache of two generations: when it is full it becomes the older one, from which what is
    asked for again is taken over; what is not goes with the next change.  Words that recur stay,
    those that come once do not push them out."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.older = limit, make, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordTokens:
    """Token ids of texts, word by word: the vocabulary's pre-tokenizer never joins words
    across white space, so a word's ids do not depend on its neighbours.

    A word of printable ASCII and Latin-1 letters is cut into lower-case pieces here, as the
    vocabulary's pattern does, and only pieces not seen before go through its merges; any
    other word, and one that may hold a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os
        import re
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Recent(CACHED_WORDS, self.word)
        self.pieces = Recent(CACHED_PIECES, self.piece)
        self.letters = byte_letters()
        # The pre-tokenizer's pattern, for these characters.
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]+")
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def piece(self, piece: str) -> bytes:
        import numpy as np
        written = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(written)], "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        import numpy as np
        text = word.decode("utf-8", "replace")
        if self.plain.fullmatch(text) and "<|" not in text:
            return b"".join([self.pieces[p] for p in self.cut(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, texts: list) -> list:
        """Little-endian unsigned 32-bit ids of each text (bytes)."""
        return [b"".join([self.words[w] for w in t.split()]) for t in texts]


def texts_in_parts(texts: list, n: int = 128, most_bytes: int = 1 << 20):
    """Consecutive runs of texts of bounded number and size."""
    part, size = [], 0
    for t in texts:
        if part and (len(part) >= n or size + len(t) > most_bytes):
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _cutter(path: str, capacity: int, with_ids: bool):
    def run(batches):
        import zlib
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        tokens = worker_store("tokens " + path, lambda: WordTokens(path))
        seen: dict = {}
        names = [f.split()[0] for f in PIECES.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            keys = iter(zip(batch["doc_id"].to_pylist(), batch["doc_key"].to_pylist()))
            for part in texts_in_parts(binary_list(batch["text"])):
                rows, ids = [], []
                for data in tokens.of(part):
                    doc_id, key = next(keys)
                    data += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at:at + 4 * capacity]
                        nth = seen[len(own)] = seen.get(len(own), -1) + 1
                        rows.append((doc_id, key, piece, at // 4, len(own) // 4, zlib.crc32(own), task, nth))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)
    return run


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``task`` and ``nth`` count the pieces of a length."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("doc_key"), text.alias("text"))
    return slim.mapInArrow(_cutter(path, capacity, with_ids), PIECES + ", ids array<int>" * with_ids)


def exact_fill(left, gap: int) -> tuple | None:
    """One, two or three available lengths whose sum is ``gap`` (``left``: counts by length)."""
    import numpy as np
    if gap < 1:
        return None
    if left[gap] > 0:
        return (gap,)

    def pair(total: int, free):
        if total < 2:
            return None
        b = np.arange(total - 1, (total - 1) // 2, -1)          # the larger of the two, longest first
        b = b[b < len(free)]
        c = total - b
        ok = (free[b] > 0) & (free[c] > 0) & ((b != c) | (free[b] > 1))
        at = int(ok.argmax()) if ok.any() else -1
        return None if at < 0 else (int(b[at]), int(c[at]))
    two = pair(gap, left)
    if two:
        return two
    for a in np.flatnonzero(left[:gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        left[a] -= 1
        two = pair(gap - a, left)
        left[a] += 1
        if two:
            return (a, *two)
    return None


def plan(counts: dict, capacity: int = CAPACITY) -> list:
    """[(lengths in order, number of sequences)] that use every piece once."""
    import numpy as np
    from collections import Counter
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    for first in range(capacity, 0, -1):
        while left[first] > 0:
            pattern, gap = [first], capacity - first
            free = left.copy()
            free[first] -= 1
            while gap > 0:
                fill = exact_fill(free, gap)
                if not fill:
                    fits = np.flatnonzero(free[:gap + 1] > 0)
                    if not len(fits):
                        break
                    fill = (int(fits[-1]),)
                for x in fill:
                    free[x] -= 1
                pattern += fill
                gap -= sum(fill)
            uses = Counter(pattern)
            times = min(int(left[x]) // n for x, n in uses.items())
            for x, n in uses.items():
                left[x] -= n * times
            patterns.append((tuple(pattern), times))
    return patterns


def _placer(patterns: list):
    """UDF (length, rank) -> (sequence_id, offset)."""
    length, start, sequence, offset = [], [], [], []
    used: dict = {}
    base = 0
    for pattern, times in patterns:
        at = 0
        for x in pattern:
            length.append(x)
            start.append(used.get(x, 0))
            used[x] = used.get(x, 0) + times
            sequence.append(base)
            offset.append(at)
            at += x
        base += times

    def run(lengths, ranks):
        import numpy as np
        import pyarrow as pa
        by_length, first, seq, off = (np.array(v, np.int64) for v in (length, start, sequence, offset))
        order = np.lexsort((first, by_length))
        by_length, first, seq, off = by_length[order], first[order], seq[order], off[order]
        x, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        at = np.zeros(len(x), np.int64)
        for one in np.unique(x):
            lo, hi = np.searchsorted(by_length, one), np.searchsorted(by_length, one, "right")
            own = x == one
            at[own] = lo + np.searchsorted(first[lo:hi], r[own], "right") - 1
        return pa.StructArray.from_arrays([pa.array(seq[at] + r - first[at]), pa.array(off[at])], ["sequence_id", "offset"])
    return F.arrow_udf(run, "sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset`` (and, if asked for, its ``ids``)."""
    path = path or vocabulary_path()
    pieces = written(pieces_of(docs, path, capacity, with_ids), "pieces")
    by_task = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r[0]: r[1] for r in by_task.groupBy("length").agg(F.sum("n")).collect()}     # <= capacity rows
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    place = _placer(plan(counts, capacity))
    placed = ranked.select("*", place("length", "rank").alias("place"))
    return placed.select("doc_id", "doc_key", "piece", "start", "length", "ids_crc32", F.col("place.sequence_id").alias("sequence_id"),
                         F.col("place.offset").alias("offset"), *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: at most capacity ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    got = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return got.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"),
                      F.col("parts.offset").alias("offsets"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return pack(documents(spark, sf_dir)).drop("doc_key")


_ship_by_value(__name__)
