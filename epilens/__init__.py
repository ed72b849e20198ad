"""Epidemic-intelligence analytics on PySpark DataFrames."""
