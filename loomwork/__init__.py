"""loomwork: a PySpark-native engine for text corpora (build, query, audit)."""

__version__ = "0.1.0"
