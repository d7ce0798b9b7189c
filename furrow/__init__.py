"""Map reconstruction and route validation over Spark DataFrames."""
