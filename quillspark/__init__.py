"""Text and competency analytics on Spark DataFrames."""
