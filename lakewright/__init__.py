"""Document and workspace analytics on Spark DataFrames."""
