"""Land carbon accounting on Spark DataFrames and Structured Streaming."""
