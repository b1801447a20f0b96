"""Sinks for results as files."""
