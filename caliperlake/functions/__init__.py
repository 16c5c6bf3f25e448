"""Column expressions: geometry, text and decimals, annotations."""
