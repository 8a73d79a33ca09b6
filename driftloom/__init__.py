"""Spark-native process-change analytics over event logs."""
