"""Column builders and row functions."""
