"""Readers: delimited shards, snapshots, zip archives, listing pages."""

from regspark.sources.delimited import (
    read_delimited, read_headerless, read_inferred, read_positional, read_with_header,
    read_split_malformed, rename_positional,
)
from regspark.sources.shards import ci_glob, shard_glob, scan_shards, scan_snapshots, snapshot_from_path
from regspark.sources.archives import (
    read_archive_lines, read_archives, parse_lines, split_rejects, first_member_per_archive,
)
from regspark.sources.pages import read_pages

__all__ = [n for n in dir() if not n.startswith("_")]
