"""Hierarchical-retrieval analytics on Spark DataFrames."""
