"""Relational, graph and document operators, each a function from DataFrames to a DataFrame."""
