"""Document-catalog analytics on Spark DataFrames."""
