"""Influence analysis on large probability-weighted graphs, on Spark DataFrames."""
