"""Incremental sync on Structured Streaming."""
