"""Schemas, files and tables."""
