"""Relational operators of a comparison, each a function from DataFrames to DataFrames."""
