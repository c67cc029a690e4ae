"""Scans and extractors."""
