"""Operators of a training-data pipeline: tokens, deduplication, filters, classifiers and mixing."""
