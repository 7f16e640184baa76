"""Spark-native engine for curating and searching gridded Earth-observation datasets."""
