"""Heap-graph analytics on Spark DataFrames."""
