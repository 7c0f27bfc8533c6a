"""Repertoire analytics on Spark DataFrames."""
