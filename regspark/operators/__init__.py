"""Relational operators of the registry jobs."""

from regspark.operators.dedup import dedup_full_row, dedup_effect
from regspark.operators.joins import (
    equi_join, name_join, prefix_left_join, rename_collisions, hot_key_frame,
)
from regspark.operators.counts import row_count, row_counts, union_shards
from regspark.operators.manifest import (
    wanted_facts, wanted_dimensions, wanted_manifest, manifest_available, manifest_missing,
    ingest_plan, route_archives, snapshots_available,
)
from regspark.operators.dims import (
    bounded_broadcast, lookup, lookup_dimensions, segment_of, segment_counts, load_dimension, load_dimensions,
    resolve_codes,
)

__all__ = [n for n in dir() if not n.startswith("_")]
