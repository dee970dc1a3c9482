"""Event-ranking analytics on Spark DataFrames."""
