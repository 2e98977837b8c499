"""Operators for training-data corpora, one module each, and their registered queries.

Nothing else in the library imports this subpackage.
"""
