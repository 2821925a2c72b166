"""Writers and reports."""

from regspark.sinks.writers import (
    write_parquet, write_shards, export_csv, unique_names, csv_to_parquet, STATUS_SCHEMA,
)
from regspark.sinks.reports import preview, schema_report

__all__ = [n for n in dir() if not n.startswith("_")]
