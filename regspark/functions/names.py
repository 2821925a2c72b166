"""Archive and output naming expressions.

Each helper builds a name from columns, so a whole manifest is named in one projection
instead of a Python loop over file names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regspark.functions.keys import _col


def strip_char(c, ch: str = "/") -> Column:
    """Remove ``ch`` from both ends (``'2025-01/'`` -> ``'2025-01'``)."""
    return F.btrim(_col(c), F.lit(ch))


def snapshot_label(c) -> Column:
    """Directory name without slashes: ``'2025-01/'`` -> ``'2025-01'``."""
    return strip_char(c, "/")


def compact_snapshot(c) -> Column:
    """Snapshot without slashes and hyphens: ``'2025-01/'`` -> ``'202501'``."""
    return F.replace(strip_char(c, "/"), F.lit("-"), F.lit(""))


def type_tag(c, length: int = 4) -> Column:
    """Lower-cased leading characters of a table type: ``'Empresas'`` -> ``'empr'``."""
    return F.lower(F.substring(_col(c), 1, length))


def capitalized(c) -> Column:
    """First character upper-cased, the rest lower-cased: ``'click'`` -> ``'Click'``."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def archive_name(table_type, shard) -> Column:
    """``<Type><shard>.zip`` as published: ``Empresas3.zip``."""
    return F.concat(_col(table_type), _col(shard).cast("string"), F.lit(".zip"))


def local_archive_name(table_type, shard, snapshot) -> Column:
    """``<Type><shard>-<snapshot>.zip``; the shard number is always kept."""
    return F.concat(_col(table_type), _col(shard).cast("string"), F.lit("-"),
                    snapshot_label(snapshot), F.lit(".zip"))


def output_prefix(snapshot, table_type) -> Column:
    """``<yyyymm>_<type tag>``: ``('2023-05/', 'Empresas')`` -> ``'202305_empr'``."""
    return F.concat(compact_snapshot(snapshot), F.lit("_"), type_tag(table_type))


def parquet_name(csv_name) -> Column:
    """``X.csv`` -> ``X-pq.parquet``."""
    return F.replace(_col(csv_name), F.lit(".csv"), F.lit("-pq.parquet"))
