"""Functions of the profiling engine."""
