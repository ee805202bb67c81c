"""Multi-resolution time-series analytics on Spark DataFrames."""
