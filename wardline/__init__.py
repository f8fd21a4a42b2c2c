"""Spark-native analytics over multi-camera detection data."""
