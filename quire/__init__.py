"""quire: corpus search and analytics on Spark DataFrames."""
