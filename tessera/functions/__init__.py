"""Column expressions and small helpers shared by all operators."""
