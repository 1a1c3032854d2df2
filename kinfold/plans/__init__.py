"""Composed queries over the driver tables."""
