"""cellscope: grid analytics, priority scoring and discovery simulation on Spark DataFrames."""
