"""Governed retrieval, event analytics and corpus processing on Spark DataFrames."""
