"""chronoframe: keyed numeric time series on Spark DataFrames."""
