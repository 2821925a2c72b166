"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

1. A sample of the labelled training rows, at most about ``SAMPLE`` of them by a hash of the id, is
   small enough to be sent to all tasks, so texts are not shuffled.
2. The lexicon is learned from it: words and word beginnings of 4 to 6 letters that occur in
   significantly more toxic documents than their share (z of ``MIN_Z`` or more).
3. Every text becomes a row of rates: lexicon densities, second-person words near lexicon
   words, capitals, punctuation, obfuscation.
4. Boosted trees learn on three of the four training folds, isotonic regression calibrates
   their probability on the fourth; a thousandth of the raw probability is mixed in, so that
   the order inside an isotonic step is kept.

Language, source, id and labels are never features.

Defined cases: a null text counts as empty; an empty text has all rates 0 and is scored like
any other; rows that repeat an id share its label and are scored each; ids with conflicting
labels count as toxic; a null label is no label; without both classes in the training rows
the score is the smoothed share of toxic ones (0 without any); empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.tables import documents, in_fold, with_fields, written
from regspark.llm.words import _ship_by_value, binary_list, worker_store

SAMPLE = 20_000
HELD_OUT, CALIBRATION = 0, 4
MIN_Z, MIN_DOCS, LEXICON = 6.0, 5, 4000
PREFIXES = (4, 5, 6)
NEAR = 5
TREES, DEPTH = 30, 4

# Second-person words of the four languages.
SECOND_PERSON = ("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos "
                 "du dich dir dein deine ihr euch euer sie tú ti tuyo usted ustedes vosotros os su").split()

FEATURES = ["lexicon_words", "lexicon_beginnings", "lexicon_weight", "lexicon_kinds", "lexicon_hits", "near_you",
            "second_person", "capital_letters", "capital_words", "exclamations", "questions", "punctuation",
            "symbols", "obfuscated", "stretched", "log_words"]


def letters_of(word: str) -> str:
    """The word in lower case without what is not a letter at its ends."""
    low = word.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalpha():
        a += 1
    while b > a and not low[b - 1].isalpha():
        b -= 1
    return low[a:b]


def units_of(word: str) -> list:
    """The whole word (``=word``) and its beginnings."""
    w = letters_of(word)
    return ["=" + w] * (len(w) > 2) + [w[:n] for n in PREFIXES if len(w) > n]


class WordFacts(dict):
    """word (bytes) -> (flags, lexicon weight, lexicon unit number); bounded."""
    LEX, BEGIN, YOU, CAPS, OBFUSCATED, STRETCHED = 1, 2, 4, 8, 16, 32

    def __init__(self, lexicon: dict, limit: int = 100_000):
        super().__init__()
        import re
        self.lexicon, self.limit = lexicon, limit
        self.number = {u: i + 1 for i, u in enumerate(sorted(lexicon))}
        self.you = set(SECOND_PERSON)
        self.mixed = re.compile(r"[^\W\d_][\d@$!*#_.\-]+[^\W\d_]")
        self.run = re.compile(r"([^\W\d_])\1\1")

    def __missing__(self, word: bytes) -> tuple:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8", "replace")
        flags, weight, unit = 0, 0.0, 0
        for u in units_of(text):
            z = self.lexicon.get(u, 0.0)
            if z:
                flags |= self.LEX if u[0] == "=" else self.BEGIN
                if z > weight:
                    weight, unit = z, self.number[u]
        low = letters_of(text)
        flags |= self.YOU * (low in self.you) | self.CAPS * (len(low) > 1 and text.isupper())
        flags |= self.OBFUSCATED * bool(self.mixed.search(text)) | self.STRETCHED * bool(self.run.search(low))
        fact = self[word] = (flags, weight, unit)
        return fact


def features_of(data: bytes, facts: WordFacts) -> list:
    import numpy as np
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    known = [facts[w] for w in words]
    flags = np.array([k[0] for k in known], np.int64)
    hit = (flags & 3) > 0
    weight = sum(k[1] for k in known)
    kinds = len({k[2] for k in known if k[2]})
    you = np.flatnonzero(flags & WordFacts.YOU)
    at = np.flatnonzero(hit)
    near = 0
    if len(you) and len(at):
        right = np.searchsorted(at, you)
        gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - you), np.abs(you - at[np.maximum(right - 1, 0)]))
        near = int((gap <= NEAR).sum())
    share = lambda bit: float((flags & bit > 0).sum()) / n
    size = len(data)
    capitals = sum(map(data.count, (b"%c" % c for c in range(65, 91))))
    small = sum(map(data.count, (b"%c" % c for c in range(97, 123))))
    other = size - len(data.translate(None, b".,;:'\"-()"))
    odd = size - len(data.translate(None, b"#*$%&|<>@_~^"))
    return [share(1), share(2), weight / n, float(kinds), float(hit.sum()), near / n, len(you) / n,
            capitals / max(1, capitals + small), share(WordFacts.CAPS), data.count(b"!") / n, data.count(b"?") / n,
            other / size, odd / size, share(WordFacts.OBFUSCATED), share(WordFacts.STRETCHED), math.log1p(n)]


def feature_columns(df: DataFrame, lexicon: dict) -> DataFrame:
    """``df`` plus the dense features of its ``text``."""
    def run(column):
        import pyarrow as pa
        key = hash(tuple(sorted(lexicon.items())))
        held = worker_store("toxicity", dict)
        if held.get("key") != key:
            held.update(key=key, facts=WordFacts(lexicon))
        rows = [features_of(d, held["facts"]) for d in binary_list(column)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))], FEATURES)
    udf = F.arrow_udf(run, ", ".join(f"{f} double" for f in FEATURES))
    return with_fields(df, udf(F.col("text").cast("string")), FEATURES)


def _unit_counts(batches):
    """Per task: documents that have a unit, and how many of them are toxic."""
    import pyarrow as pa
    counts: dict = {}

    def batch_of():
        units = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([counts[u][0] for u in units], pa.int64()),
                                           pa.array([counts[u][1] for u in units], pa.int64())], ["unit", "n", "toxic"])
    for batch in batches:
        for data, toxic in zip(binary_list(batch["text"]), batch["toxic"].to_pylist()):
            seen = {u for w in set(data.split()) for u in units_of(w.decode("utf-8", "replace"))}
            for u in seen:
                c = counts.setdefault(u, [0, 0])
                c[0] += 1
                c[1] += toxic
            if len(counts) > 300_000:
                yield batch_of()
                counts.clear()
    if counts:
        yield batch_of()


def learn_lexicon(sample: DataFrame, share: float) -> dict:
    """unit -> z of its toxic share against ``share``, the ``LEXICON`` strongest units at most."""
    units = sample.select("text", "toxic").mapInArrow(_unit_counts, "unit string, n long, toxic long")
    sums = units.groupBy("unit").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCS)
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    best = sums.select("unit", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "unit").limit(LEXICON)
    return {r["unit"]: float(r["z"]) for r in best.collect()}


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Labelled documents outside the held-out fold (about ``sample`` at most), one per text."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("label_id is not null and toxic is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
              .where(~in_fold(F.col("label_id"), HELD_OUT)))
    n = marked.count()
    if n > sample:
        marked = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    got = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # the sample is bounded by ``sample`` ids of 12 bytes
    got = got.join(F.broadcast(marked), got["doc_id"] == marked["label_id"])
    return got.select("doc_id", "text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A function that adds ``score`` to any documents."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = written(training_sample(docs, labels, sample), "toxic-sample")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, t = total["n"], total["t"] or 0
    constant = (t + 0.5) / (n + 1) if n else 0.0
    if not 0 < t < n:
        return lambda df: df.withColumn("score", F.lit(float(constant)))
    lexicon = learn_lexicon(rows, t / n)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="__features")
    ready = written(feature_columns(rows, lexicon).select("doc_id", "toxic", *FEATURES), "toxic-features")
    learn = vectors.transform(ready.where(~in_fold(F.col("doc_id"), CALIBRATION)))
    if learn.select("toxic").distinct().count() < 2:
        learn = vectors.transform(ready)
    trees = GBTClassifier(labelCol="toxic", featuresCol="__features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2,
                          minInstancesPerNode=3, subsamplingRate=0.8, seed=7).fit(learn)

    def raw(df):
        got = trees.transform(vectors.transform(df))
        return got.withColumn("raw", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction")
    held = ready.where(in_fold(F.col("doc_id"), CALIBRATION))
    if held.select("toxic").distinct().count() < 2:
        held = ready
    steps = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="step").fit(raw(held))

    def score(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c.lower() not in {f.lower() for f in FEATURES} | {"raw", "step", "score"}]
        got = steps.transform(raw(feature_columns(df.select(*keep), lexicon)))
        return got.withColumn("score", F.col("step") * 0.999 + F.col("raw") * 0.001).drop("step", "raw", *FEATURES)
    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted``."""
    scored = train(docs, labels, sample)(docs)
    return scored.withColumns({"held_out": in_fold(F.col("doc_id"), HELD_OUT), "predicted": (F.col("score") >= 0.5).cast("int")})


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


_ship_by_value(__name__)
