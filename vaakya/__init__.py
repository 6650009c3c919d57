"""Transcript and text analytics on Spark DataFrames."""
