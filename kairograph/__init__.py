"""Bi-temporal knowledge-graph memory on Spark DataFrames."""
