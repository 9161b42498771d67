"""fieldloom: panel-data analytics on Spark DataFrames."""
