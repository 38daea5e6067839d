"""Repeat-purchase analytics on Spark DataFrames."""
