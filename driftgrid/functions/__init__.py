"""Column expressions: selections, labels, masks and scalings."""
