"""Content-based recommendation and the text preparation behind it, on Spark DataFrames."""
