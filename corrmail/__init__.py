"""Correspondence analytics on Spark DataFrames."""
