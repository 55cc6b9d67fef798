"""Training-data operators: mixing, deduplication, filtering and scoring of text and vectors.

Nothing outside this subpackage imports it.
"""
