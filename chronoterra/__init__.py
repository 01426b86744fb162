"""Versioned geodata analytics on Spark DataFrames."""
