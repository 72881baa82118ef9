"""Column expressions. Each takes and returns Columns; none runs Python per row."""
