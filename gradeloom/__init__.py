"""Education analytics on Spark DataFrames."""
