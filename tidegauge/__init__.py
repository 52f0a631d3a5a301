"""Access-log capacity analytics on Spark DataFrames."""
