"""Spark-native vector-tile analytics over OpenStreetMap-shaped tables."""
