"""Column builders and SQL functions."""
