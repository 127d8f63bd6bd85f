"""Software-dependency graphs and corpus preparation on Spark DataFrames."""
