"""Glyphmill: parallel-corpus analytics on Spark DataFrames."""
