"""Operators over refs, objects, tables and histories."""
