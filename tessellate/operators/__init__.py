"""Operators from DataFrames to DataFrames, parameterised by column roles."""
