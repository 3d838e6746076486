"""Structured Streaming: the resumable, incremental collector."""
