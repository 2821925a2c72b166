"""Ranked lexical search with hashed max-sketches.

Every document folds its terms' counts into hashed coordinates, of which there are ``SPREAD``
times as many as it has distinct terms, and keeps the maximum of each.  What a term adds to a
score grows with its count, so the coordinate bounds the impact of every term that falls on it,
whatever the corpus statistics are, which come in at query time.  The sketches are written once.

The queries are looked up in batches, in blocks of at most ``BLOCK_BYTES`` of text: the sum of a
query's weights times the impacts on its coordinates is an upper bound of each document's score.

1. For every query the ``HEAD`` texts with the greatest bounds are scored exactly; the k-th score
   among their documents is its threshold.
2. In descending order of bounds, all texts down to that threshold are scored exactly.  No text
   with a bound below it can be among the k best.

Equal texts have equal scores: they are searched as one, and only the k smallest ids of each text
are carried along, so that a group of copies of any size adds k rows to a ranking.

Weight of a term: floor(1000 ln((2N+2)/(2df+1))); m of a document: 25 + (75 n N) div L; score: sum
over the query's terms, repeats included, of weight * ((10^9 tf) div (1000 tf + 8 m)).

Defined cases: null and empty texts have no terms and are never found; a query without terms has
no rows; a text of any length is indexed whole; equal scores come by ascending id, null ids last;
repeated rows of a document are documents of their own; queries equal in id and text are one, those
with one id and different texts are ranked apart; an empty table gives an empty result.  Columns
other than id and text are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regspark.llm.tables import documents, written
from regspark.llm.words import _ship_by_value, binary_list, word_hashes

K = 10
SPREAD = 16
LEAST_WIDTH = 256
HEAD = 40
BLOCK_BYTES = 1 << 20
#: cells of a dense block of sketches, of four bytes
CELLS = 1 << 21

SKETCH = "text_key binary, n long, width long, coords binary, peaks binary"
BOUNDS = "item int, text_key binary, bound double"
SCORES = "item int, text_key binary, score long"

# Bytes outside terms become blanks, A-Z become lower case.
_CUT = [range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)]
_TABLE = bytes(0x20 if any(c in r for r in _CUT) else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def terms(data: bytes) -> list:
    return data.translate(_TABLE).split()


def width_of(distinct: int) -> int:
    width = LEAST_WIDTH
    while width < SPREAD * distinct:
        width *= 2
    return width


def sketch(found: list) -> tuple:
    """(width, sorted coordinates, greatest count on each; 255 stands for all above)."""
    import numpy as np
    from collections import Counter
    counts = Counter(found)
    width = width_of(len(counts))
    at = (word_hashes(list(counts)) & np.uint64(width - 1)).astype(np.uint32)
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), 255).astype(np.uint8)
    order = np.argsort(at, kind="stable")
    at, tf = at[order], tf[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    return width, at[first], np.maximum.reduceat(tf, first) if len(first) else tf


def _sketches(batches):
    import pyarrow as pa
    names = ["text_key", "n", "width", "coords", "peaks"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        out = [[] for _ in names]
        for key, data in zip(batch["text_key"].to_pylist(), binary_list(batch["text"])):
            found = terms(data)
            width, at, tf = sketch(found)
            for column, value in zip(out, (key, len(found), width, at.tobytes(), tf.tobytes())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def _holders(asked: list):
    """Task function: in how many of the task's documents each of the terms ``asked`` is."""
    def run(batches):
        from collections import Counter
        import pyarrow as pa
        known = dict(zip(asked, range(len(asked))))
        held: Counter = Counter()
        for batch in batches:
            for data in binary_list(batch["text"]):
                held.update(known.keys() & set(terms(data)))
        yield pa.RecordBatch.from_pydict({"term": pa.array([known[t] for t in held], pa.int32()),
                                          "df": pa.array(list(held.values()), pa.int64())})
    return run


class Block:
    """Queries of one block: their distinct terms, with numbers, and how often each query has them."""

    def __init__(self, items: list):
        from collections import Counter
        self.ids = [i for i, _ in items]
        numbers: dict = {}
        self.terms_of = []
        for _, text in items:
            counts = Counter(terms((text or "").encode()))
            self.terms_of.append([(numbers.setdefault(t, len(numbers)), c) for t, c in counts.items()])
        self.terms = list(numbers)


class Corpus:
    """Corpus statistics and the weights of a block's terms."""

    def __init__(self, n_docs: int, n_terms: int, df: list):
        from math import floor, log
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = [floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df]

    def m(self, n):
        return 25 + 75 * n * self.n_docs // self.n_terms


def bounds_of(widths, lengths, coords: list, peaks: list, block: Block, corpus: Corpus, hashes, heavy: list):
    """Yields (row numbers, query number, bounds of these rows)."""
    import numpy as np
    for width in np.unique(widths).tolist():
        of_width = np.flatnonzero(widths == width)
        step = max(1, CELLS // width)
        for i in range(0, len(of_width), step):
            rows = of_width[i:i + step]
            dense = np.zeros((width, len(rows)), np.float32)
            for j, r in enumerate(rows.tolist()):
                tf = np.frombuffer(peaks[r], np.uint8).astype(np.float64)
                impact = 1e9 * tf / (1000 * tf + 8.0 * float(corpus.m(int(lengths[r]))))
                impact[tf == 255] = 1e6
                dense[np.frombuffer(coords[r], np.uint32), j] = impact
            at = (hashes & np.uint64(width - 1)).astype(np.int64)
            for q, (numbers, weights) in enumerate(heavy):
                if len(numbers):
                    yield rows, q, weights @ dense[at[numbers]]


def _bound_task(block: Block, corpus: Corpus, head: int, thresholds: list | None):
    """Task function: of every query, the ``head`` texts with the greatest bounds in the task, or
    all those whose bound reaches its threshold."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        hashes = word_hashes(block.terms)
        heavy = []
        for counted in block.terms_of:
            numbers = np.array([t for t, _ in counted], np.int64)
            weights = np.array([corpus.weights[t] * c for t, c in counted], np.float32)
            # the margin is wider than what sums of 32-bit floats lose
            heavy.append((numbers, weights * np.float32(1 + 1e-6 * (len(counted) + 10))))

        def rows_of(found):
            items, keys, bounds = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_pydict({"item": pa.array(items, pa.int32()), "text_key": pa.array(keys, pa.binary()),
                                               "bound": pa.array(bounds, pa.float64())})
        best: list = [{} for _ in heavy]            # key -> bound
        floor = [1.0] * len(heavy) if thresholds is None else [float(max(t, 1)) for t in thresholds]
        for batch in batches:
            keys = batch["text_key"].to_pylist()
            columns = [batch[c].to_pylist() for c in ("coords", "peaks")]
            found = set()
            for rows, q, bounds in bounds_of(batch["width"].to_numpy(), batch["n"].to_numpy(), *columns,
                                             block, corpus, hashes, heavy):
                hit = np.flatnonzero(bounds >= floor[q])
                if thresholds is not None:
                    found.update((q, keys[rows[j]], float(bounds[j])) for j in hit.tolist())
                    continue
                if len(hit) > head:
                    hit = hit[np.argpartition(-bounds[hit], head - 1)[:head]]
                top = best[q]
                for j in hit.tolist():
                    top[keys[rows[j]]] = float(bounds[j])
                if len(top) > 4 * head:
                    best[q] = dict(sorted(top.items(), key=lambda x: -x[1])[:head])
                    floor[q] = max(floor[q], min(best[q].values()))
            if found:
                yield rows_of(sorted(found))
        for q, top in enumerate(best):
            if top:
                yield rows_of([(q, key, bound) for key, bound in sorted(top.items(), key=lambda x: -x[1])[:head]])
    return run


def _score_task(block: Block, corpus: Corpus):
    """Task function: exact scores of texts for their listed queries."""
    def run(batches):
        from collections import Counter
        import pyarrow as pa
        for batch in batches:
            out = ([], [], [])
            for key, data, items in zip(batch["text_key"].to_pylist(), binary_list(batch["text"]), batch["items"].to_pylist()):
                found = terms(data)
                counts, m = Counter(found), corpus.m(len(found))
                impact = {}
                for q in items:
                    score = 0
                    for t, c in block.terms_of[q]:
                        if t not in impact:
                            tf = counts.get(block.terms[t], 0)
                            impact[t] = corpus.weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m)) if tf else 0
                        score += c * impact[t]
                    if score > 0:
                        for column, value in zip(out, (q, key, score)):
                            column.append(value)
            yield pa.RecordBatch.from_pydict({"item": pa.array(out[0], pa.int32()), "text_key": pa.array(out[1], pa.binary()),
                                              "score": pa.array(out[2], pa.int64())})
    return run


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def blocks(items: DataFrame, block_bytes: int):
    """The distinct queries, as lists of (id, text) of about ``block_bytes`` of text."""
    held, size = [], 0
    for row in items.where("text is not null").distinct().toLocalIterator():
        n = len(row["text"].encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["id"], row["text"]))
        size += n
    if held:
        yield held


class Index:
    """Sketches of all texts, and the ``k`` smallest ids of each text."""

    def __init__(self, docs: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text"):
        self.k = k
        self.docs = (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
                     .where("text is not null").withColumn("text_key", text_digest(F.col("text"))))
        self.sketches = written(self.docs.select("text_key", "text").mapInArrow(_sketches, SKETCH), "max-sketches")
        smallest = Window.partitionBy("text_key").orderBy(F.asc_nulls_last("doc_id"))
        copies = self.docs.select("text_key", "doc_id").withColumn("no", F.row_number().over(smallest)).where(F.col("no") <= k)
        self.copies = written(copies, "text-copies")
        totals = self.sketches.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        self.n_docs, self.n_terms = totals["docs"], totals["terms"] or 0

    def corpus(self, block: Block) -> Corpus:
        df = [0] * len(block.terms)
        held = self.docs.select("text").mapInArrow(_holders(block.terms), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        for row in held.collect():                 # one for each term of the block at most
            df[row["term"]] = row["df"]
        return Corpus(self.n_docs, self.n_terms, df)

    def scored(self, pairs: DataFrame, block: Block, corpus: Corpus) -> DataFrame:
        """Exact scores of the ``pairs`` (item, text_key), read from one document of each text."""
        lists = pairs.groupBy("text_key").agg(F.collect_set("item").alias("items"))
        one = self.copies.where("no = 1").select("text_key", F.col("doc_id").alias("one_id")).join(lists, "text_key")
        one = one.withColumnRenamed("text_key", "one_key")
        same = (F.col("text_key") == F.col("one_key")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
        rows = self.docs.join(one, same).select("text_key", "text", "items")
        return rows.mapInArrow(_score_task(block, corpus), SCORES).distinct()

    def best(self, scores: DataFrame) -> DataFrame:
        """(item, doc_id, score, rank) of the ``k`` best documents of each query."""
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "text_key", "no")
        return (scores.join(self.copies, "text_key").withColumn("rank", F.row_number().over(order))
                .where(F.col("rank") <= self.k).select("item", "doc_id", "score", "rank"))

    def search(self, items: list, head: int = HEAD) -> DataFrame:
        """(item_id, rank, doc_id, score) for one block of (id, text) queries."""
        block = Block(items)
        corpus = self.corpus(block)
        first = self.sketches.mapInArrow(_bound_task(block, corpus, head, None), BOUNDS).distinct()
        order = Window.partitionBy("item").orderBy(F.desc("bound"), "text_key")
        first = first.withColumn("no", F.row_number().over(order)).where(F.col("no") <= head)
        thresholds = [0] * len(items)
        for row in self.best(self.scored(first, block, corpus)).where(F.col("rank") == self.k).collect():
            thresholds[row["item"]] = row["score"]  # one for each query at most
        rest = self.sketches.mapInArrow(_bound_task(block, corpus, head, thresholds), BOUNDS).select("item", "text_key").distinct()
        found = self.best(self.scored(rest, block, corpus))
        ids = F.array(*[F.lit(i).cast("long") for i in block.ids])
        return found.select(F.get(ids, F.col("item")).alias("item_id"), F.col("rank").cast("int"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, item_id: str = "item_id", item_text: str = "text",
                  doc_id: str = "doc_id", text: str = "text", head: int = HEAD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query of ``items``."""
    index = Index(docs, k, doc_id, text)
    asked = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    found = [index.search(block, head) for block in blocks(asked, block_bytes)] if index.n_terms else []
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return ranked_search(documents(spark, sf_dir), items)


_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP13_SQL = f"""with d as (select row_number() over () as rid, doc_id, {_TERMS} as ts from documents),
item as (select row_number() over () as no, item_id, ts from (select distinct item_id, text, {_TERMS} as ts from benchmark)),
asked as (select no, term, count(*) as times from (select no, unnest(ts) as term from item) group by no, term),
size as (select rid, doc_id, len(ts) as n from d where len(ts) > 0),
total as (select count(*) as docs, sum(n)::bigint as terms from size),
tf as (select rid, term, count(*) as tf from (select rid, unnest(ts) as term from d) where term in (select term from asked)
  group by rid, term),
weight as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total group by term, docs),
hit as (select no, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
  from asked join tf using (term) join weight using (term) join size using (rid), total group by no, rid),
ranked as (select no, doc_id, score, row_number() over (partition by no order by score desc, doc_id nulls last, rid) as rank
  from hit join size using (rid) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked join item using (no) where rank <= 10"""


_ship_by_value(__name__)
