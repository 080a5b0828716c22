"""Lattica: a PySpark-native engine for typed dependency graphs, the text and the history around them."""

__version__ = "0.1.0"
