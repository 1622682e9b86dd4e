"""Reusable relational building blocks at a fixed grain."""
