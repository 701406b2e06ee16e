"""Analytics on Spark DataFrames."""
