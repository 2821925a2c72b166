"""Training-data pipeline over the whole ``documents`` table.

Stages, in order: quality rules (rejected documents go), near-duplicate detection (one
document of each group stays), substring de-duplication (later copies of passages are cut
out of the texts), benchmark decontamination (documents that hold a benchmark item go) and
best-fit packing (one row per piece).  Each stage's rows are written as Parquet to the
shared folder and read again by the next.

All stages but the last return the columns of ``documents``; a text that is cut gets its
``n_chars`` anew, and a document of which nothing is left stays with an empty text.  A null
id is a document of its own; rows equal in id and text are one document from the
near-duplicate stage on.  Texts of any length are treated whole, an empty table gives an empty
result, and columns named like those of an operator are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.decontaminate import contaminated
from regspark.llm.near_dedup import near_duplicates
from regspark.llm.packing import pack
from regspark.llm.quality_rules import compression_bands
from regspark.llm.substring_dedup import remove_repeats
from regspark.llm.tables import documents, text_key, written

SHINGLE, SIMILARITY = 5, 0.8


def _packed(docs: DataFrame) -> DataFrame:
    """Id and text of ``docs``, its other columns in one: no operator's own columns meet them."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__none"), *rest).alias("__rest"))


def _unpacked(packed: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` again, but for those ``changed``."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c] for c in docs.columns}
    return packed.select(*[changed.get(c, value).alias(c) for c, value in own.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the compression bands keep."""
    return _unpacked(compression_bands(_packed(docs)).where("kept"), docs)


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` with (or without) a row of ``keys`` (doc_id, doc_key)."""
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(keys["doc_id"]) & (keyed["__key"] == keys["doc_key"])
    return keyed.join(keys, same, how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    kept = near_duplicates(docs, SHINGLE, SIMILARITY).where("kept").select("doc_id", "doc_key")
    # the same plain keys for the rows' first ones and for the match: the texts are dealt once
    own = [F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__none")]
    keyed = docs.select("*", *own, text_key(F.col("text")).alias("__key"))
    kept = kept.select(*own, F.col("doc_key").alias("__key"))
    keys = ["__id", "__none", "__key"]
    return keyed.dropDuplicates(keys).join(kept, keys, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document already has in a long passage."""
    changed = {}
    if "n_chars" in docs.columns:
        same = F.col("__rest")["n_chars"]
        changed["n_chars"] = (F.when(F.col("n_removed") > 0, F.length("text")).otherwise(same)
                              .cast(docs.schema["n_chars"].dataType))
    return _unpacked(remove_repeats(_packed(docs)), docs, **changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    hits = contaminated(docs, benchmark).select("doc_id", "doc_key").distinct()
    return _matched(docs, hits, "left_anti").drop("__key")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the training sequences."""
    return pack(docs).drop("doc_key")


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: the stages use zstandard, sketches and a tokenizer, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
