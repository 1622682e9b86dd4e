"""Validation of rows as they arrive."""
