"""A Spark-native engine for indexing and searching code and text corpora."""

__version__ = "0.1.0"
