"""Operators for training-data pipelines, one module each.

Nothing else in the library imports this subpackage.  ``registry`` holds the
thin queries that apply each operator to its whole table.
"""
