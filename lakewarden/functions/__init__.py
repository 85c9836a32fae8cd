"""Column expressions: everything here is a native Catalyst expression."""
