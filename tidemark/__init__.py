"""Tidemark: versioned, content-addressed and fork-aware data on Spark DataFrames."""
