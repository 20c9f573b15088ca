"""Column expressions: geometry, masks, colours and literals."""
