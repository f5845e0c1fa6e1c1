"""parley: conversation analytics as Spark DataFrames."""
