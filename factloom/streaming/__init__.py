"""Incremental variants on Structured Streaming; each has a batch twin with equal results."""
