"""Column expressions: time, intervals, numbers."""
