"""Column expressions: null-safe arithmetic, labels, and index formulas."""
