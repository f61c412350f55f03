"""Spark-native analytics over repeating spoken-broadcast data."""
