"""Vehicle-market analytics on Spark DataFrames."""
