"""Column expressions: numbers and plane geometry."""
