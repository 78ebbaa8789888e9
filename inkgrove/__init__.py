"""Spark-native document analytics: parsing, tables, corpus search and evidence as DataFrame operators."""

__version__ = "0.1.0"
