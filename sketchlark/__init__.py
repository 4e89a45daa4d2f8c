"""Sketch-mapping analytics on Spark DataFrames."""
