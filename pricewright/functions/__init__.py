"""Column functions: product names, numbers, dates."""
