"""Composite queries and the catalogue of queries with their SQL."""
