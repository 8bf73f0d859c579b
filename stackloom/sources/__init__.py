"""Sources of the profiling engine."""
