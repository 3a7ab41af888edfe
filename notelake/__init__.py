"""Spark-native analytics over collections of short, structured knowledge records."""

__version__ = "0.1.0"
