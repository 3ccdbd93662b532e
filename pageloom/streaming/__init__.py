"""Structured Streaming forms of the queue operators."""
