"""Column expressions: every function maps Columns to a Column."""
