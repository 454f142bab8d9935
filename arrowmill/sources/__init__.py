"""Readers of tables, and the catalogue of the test tables."""
