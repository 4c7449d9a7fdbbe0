"""Skein: graph, text and vector analytics on Spark DataFrames."""
