"""Spark-native screening of gridded time series."""

__version__ = "0.1.0"
