"""Queries as plans, and the catalog that resolves names."""
