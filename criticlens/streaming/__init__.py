"""Structured Streaming versions of three batch operators."""
