"""A Spark-native engine for finding similar content in document collections."""

__version__ = "0.1.0"
