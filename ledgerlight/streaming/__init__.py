"""Structured Streaming counterparts of the incremental feeds."""
