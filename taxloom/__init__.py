"""Spark-native analytics over tax and banking documents."""
