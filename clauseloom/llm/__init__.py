"""Operators for training-data pipelines: mixing, tokenizing, search, deduplication, screening.

Nothing outside this package imports it.
"""
