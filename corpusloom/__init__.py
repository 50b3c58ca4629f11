"""Corpus intelligence on Spark: operators from DataFrames to DataFrames."""
