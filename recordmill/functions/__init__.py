"""Column functions: pure expressions, no Python workers."""
