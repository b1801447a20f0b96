"""Queries over the input tables, with their SQL."""
