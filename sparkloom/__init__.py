"""Spark-native feature engineering and analytics engine."""
