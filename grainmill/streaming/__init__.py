"""Structured Streaming forms of the running totals."""
