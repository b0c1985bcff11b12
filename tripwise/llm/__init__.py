"""Operators for training-data pipelines over documents, pages and benchmark items.

Nothing else in the library imports this package; ``queries`` holds the registered
queries and their comparison SQL.
"""
