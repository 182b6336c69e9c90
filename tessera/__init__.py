"""Property-graph and training-data analytics on Spark DataFrames."""
