"""Column expressions and name helpers."""
