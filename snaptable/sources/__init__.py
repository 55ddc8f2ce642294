"""Databases, files and the store."""
