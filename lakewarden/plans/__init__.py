"""Whole flows: governed queries, join detection runs, answered questions."""
