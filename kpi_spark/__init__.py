"""Marketing and KPI measurement on Spark DataFrames."""
