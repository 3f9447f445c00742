"""Rows from HTML pages, office files and landed data."""
