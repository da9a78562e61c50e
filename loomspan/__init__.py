"""Web-corpus analytics on Spark DataFrames."""
