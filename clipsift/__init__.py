"""Clip-ranking analytics on Spark DataFrames."""
