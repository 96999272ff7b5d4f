"""Analytics operators for tables and streams as functions from DataFrames to DataFrames."""
