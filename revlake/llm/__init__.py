"""Operators of a training-data pipeline over the ``documents`` family of tables.

Nothing else in the package imports this subpackage.
"""
