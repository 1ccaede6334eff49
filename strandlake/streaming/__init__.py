"""Queries over files as they arrive."""
