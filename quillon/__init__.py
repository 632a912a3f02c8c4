"""Quillon: table analytics on Spark DataFrames."""
