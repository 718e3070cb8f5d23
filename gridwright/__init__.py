"""Spark-native analytics over messy spreadsheets and tables."""
