"""Content-analytics operators on Spark DataFrames."""
