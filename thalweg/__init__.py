"""Gridded and monthly time-series analytics on Spark DataFrames."""
