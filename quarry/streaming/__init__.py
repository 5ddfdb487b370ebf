"""Incremental indexing by Structured Streaming."""
