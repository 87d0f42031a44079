"""Larkspur: retrieval and memory analytics on PySpark DataFrames."""
