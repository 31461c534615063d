"""Operation-log analytics on Spark DataFrames."""
