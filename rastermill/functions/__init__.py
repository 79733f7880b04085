"""Column functions and fixed dimension tables."""
