"""Operators over graph, search and derived tables."""
