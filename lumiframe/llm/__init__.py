"""Operators of a training-data pipeline and the queries that apply them.

Nothing else in the library imports this subpackage.
"""
