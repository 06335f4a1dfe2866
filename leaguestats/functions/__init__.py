"""Column expressions, metric formulas and schemas."""
