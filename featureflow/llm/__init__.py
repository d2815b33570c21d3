"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; it may use the general
session helpers.  Each module holds one operator; ``queries`` holds the
registered queries and their SQL.
"""
