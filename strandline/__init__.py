"""Strandline: a Spark-native engine for data lineage and for cleaning the records around it."""

__version__ = "0.1.0"
