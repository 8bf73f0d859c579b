"""Continuous-profiling analytics on Spark DataFrames."""
