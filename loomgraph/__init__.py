"""Structural graph analytics on Spark: typed graphs as two DataFrames, operators as plans."""
