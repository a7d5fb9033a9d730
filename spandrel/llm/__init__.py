"""Operators for training-data pipelines over `documents`, `pages` and `benchmark` tables.

Nothing else in the library imports this subpackage.
"""
