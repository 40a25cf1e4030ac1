"""Structured Streaming versions of the incremental stages."""
