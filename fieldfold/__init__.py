"""Spark-native engine that turns overlapping survey detections into one record per object."""

__version__ = "0.1.0"
