"""Canonical rows and column functions."""
