"""Structured Streaming forms of the incremental counters."""
