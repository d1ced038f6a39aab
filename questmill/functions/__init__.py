"""Column functions: keys, text, numbers."""
