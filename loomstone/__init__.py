"""Corpus preparation, encoding and evaluation analytics on Apache Spark."""

__version__ = "0.1.0"
