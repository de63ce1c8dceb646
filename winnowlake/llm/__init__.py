"""Operators of a training-data pipeline: scoring, deduplication, tokenizing, filtering, sharding.

Nothing else in the package imports this subpackage.
"""
