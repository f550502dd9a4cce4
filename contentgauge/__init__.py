"""Content-quality analytics on Spark DataFrames."""
