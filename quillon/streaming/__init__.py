"""Change capture, listeners and their graphs."""
