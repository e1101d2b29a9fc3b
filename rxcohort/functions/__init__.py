"""Column and aggregate helpers made of built-in functions."""
