"""Column expressions and statistical building blocks."""
