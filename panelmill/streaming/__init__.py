"""Structured Streaming: the same bars from an unbounded input."""
