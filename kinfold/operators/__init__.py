"""Relational and statistical operators over typed relations."""
