"""Spark-native particle-track analytics and corpus operators."""
