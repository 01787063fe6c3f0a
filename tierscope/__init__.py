"""An analytics engine for panels of price observations, on Spark DataFrames."""
