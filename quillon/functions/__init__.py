"""Column functions and functions on nested values."""
