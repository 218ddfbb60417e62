"""Structured Streaming twins of the ordered and incremental operators."""
