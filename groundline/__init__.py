"""Grounded retrieval analytics on Spark DataFrames."""
