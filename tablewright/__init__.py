"""Schema analysis, normalization and model building on Spark DataFrames."""
