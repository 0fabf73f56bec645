"""Nested, shape-first queries and writes over Spark DataFrames."""
