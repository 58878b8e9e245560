"""Ordina: a PySpark-native analytics engine for ordered symbolic data."""
