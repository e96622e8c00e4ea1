"""Column expressions and distributed rank / distribution helpers."""
