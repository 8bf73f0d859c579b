"""Plans of the profiling engine."""
