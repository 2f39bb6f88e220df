"""Column functions: everything here is a built-in expression, no Python worker."""
