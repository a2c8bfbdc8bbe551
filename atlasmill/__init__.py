"""Spark-native analytics for building and auditing cross-domain question sets."""
