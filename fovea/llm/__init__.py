"""Operators for training-data pipelines: each is a function from DataFrames to DataFrames."""
