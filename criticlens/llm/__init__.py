"""Operators for preparing text corpora at scale: extraction, filtering, deduplication and mixing."""
