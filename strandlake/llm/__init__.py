"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries and their DuckDB equivalents; each other module holds one operator.
"""
