"""Property graphs as DataFrames and algorithms over them."""
