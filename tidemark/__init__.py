"""Spark-native analytics for placing independent recordings on one time axis."""
