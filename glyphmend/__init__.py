"""Diacritics restoration and text analytics as PySpark DataFrame operations."""
