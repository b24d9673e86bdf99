"""Column expressions and the small statistics helpers."""
