"""Bulk knowledge-retrieval analytics on Spark DataFrames."""
