"""Spark-native analytics for branching structures and for the tables around them."""
