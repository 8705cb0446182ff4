"""Column expressions and the registry of series statistics."""
