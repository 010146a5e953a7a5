"""Spark-native analytics for daily solar-energy readings."""
