"""Operators for large text corpora used as training data.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames;
``queries.py`` registers one query for each over the given tables.
"""
