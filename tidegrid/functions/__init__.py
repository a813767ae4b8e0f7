"""Column functions: time, text, scalar."""
