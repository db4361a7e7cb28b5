"""Data-compliance analytics on Spark DataFrames."""
