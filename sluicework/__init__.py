"""Model-artifact audit engine on Spark DataFrames."""
