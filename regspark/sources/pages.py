"""Listing pages saved as HTML files, read as ``(url, html)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, glob_filter: str = "*.html") -> DataFrame:
    """One row per HTML file: ``(url, html)`` where ``url`` is the file path."""
    return (spark.read.option("wholetext", "true").option("pathGlobFilter", glob_filter)
            .text(path)
            .select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")))
