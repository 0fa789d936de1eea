"""Evidence governance on Spark: transforms from DataFrames to DataFrames."""
