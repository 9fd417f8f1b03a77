"""Operators of a training-data pipeline over text, vectors and pages.

Nothing else in the library imports this package.
"""
