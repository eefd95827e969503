"""Folioweave: Spark-native processing of bibliographic records and documents."""

__version__ = "0.1.0"
