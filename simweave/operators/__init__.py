"""The stages of an analysis, each a function from DataFrames to a DataFrame."""
