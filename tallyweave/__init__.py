"""Frequent-item analytics on PySpark DataFrames."""
