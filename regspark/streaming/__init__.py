"""Streaming: incremental shard ingestion."""

from regspark.streaming.incremental import shard_stream, ingest_new_shards, ingest_new_archives

__all__ = ["shard_stream", "ingest_new_shards", "ingest_new_archives"]
