"""Column functions, all of built-in expressions."""
