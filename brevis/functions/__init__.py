"""Column functions: nothing here reads a table."""
