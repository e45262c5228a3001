"""Structured Streaming forms of the result roll-ups."""
