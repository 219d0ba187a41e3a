"""Gneiss: a PySpark-native analytics engine."""
