"""Periodic snapshots as a stream."""
