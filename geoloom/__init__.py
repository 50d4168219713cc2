"""Map analytics and facility planning on Spark DataFrames."""
