"""Column expressions and fixed rules."""
