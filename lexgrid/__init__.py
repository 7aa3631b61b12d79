"""Citation-graph and document analytics on Spark DataFrames."""
