"""Column expressions and scalar helpers shared by operators."""
