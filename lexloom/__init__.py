"""Lexloom: a PySpark-native text index, query and corpus analytics engine."""

__version__ = "0.1.0"
