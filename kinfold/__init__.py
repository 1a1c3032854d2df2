"""Kinfold: a PySpark-native engine for gene-family clustering results."""

__version__ = "0.1.0"
