"""Column expressions. Nothing here runs Python per row."""
