"""Tessellate: analytic operators as functions from DataFrames to DataFrames."""
