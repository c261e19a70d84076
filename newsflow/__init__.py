"""Analytics on news and social-post streams, as functions from DataFrames to DataFrames."""
