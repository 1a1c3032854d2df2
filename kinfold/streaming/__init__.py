"""Structured Streaming beyond the batch operators."""
