"""Edition alignment and corpus preparation on Spark DataFrames."""
