"""Training-data operators: deduplication, mixing, tokenizing, sharding, filters and search.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and
returns DataFrames; the queries that register them are in ``queries.py``.
"""
