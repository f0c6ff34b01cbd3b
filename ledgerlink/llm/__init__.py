"""Operators of a training-data pipeline: filters, deduplication, packing, search, encoding and classifiers."""
