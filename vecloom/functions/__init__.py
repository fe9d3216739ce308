"""Column expressions: vectors, scalars and strings."""
