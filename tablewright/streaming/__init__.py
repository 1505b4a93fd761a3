"""Structured Streaming forms of the incremental loads."""
