"""Column expressions without a plan of their own."""
