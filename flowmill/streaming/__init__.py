"""Structured Streaming forms of the stateful steps."""
