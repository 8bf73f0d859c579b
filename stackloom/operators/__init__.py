"""Operators of the profiling engine."""
