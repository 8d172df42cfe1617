"""Operators for preparing training data, with their queries.

Nothing else in the library imports this package.
"""
