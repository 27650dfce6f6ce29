"""Operators for training-data pipelines: filters, scores, deduplication, tokens."""
