"""Streaming of the profiling engine."""
