"""Training-data operators: filtering, deduplication, mixing, packing, search.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames and returns DataFrames; ``queries`` holds the registered queries.
"""
