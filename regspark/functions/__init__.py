"""Column expressions (all JVM-side built-ins)."""

from regspark.functions.keys import prefix_key, padded_key
from regspark.functions.links import (
    extract_links, resolve_link, base_name, stem, extension, url_host, strip_query,
    starts_with_any, ends_with, contains_keyword, is_present,
)
from regspark.functions.names import (
    archive_name, local_archive_name, output_prefix, parquet_name, snapshot_label, capitalized,
    compact_snapshot, type_tag, strip_char,
)
from regspark.functions.clean import (
    blank_to_null, parse_money, parse_compact_date, format_money, format_compact_date,
    clean_columns,
)

__all__ = [n for n in dir() if not n.startswith("_")]
