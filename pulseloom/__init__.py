"""Community-sentiment and market-series analytics on Spark DataFrames."""
