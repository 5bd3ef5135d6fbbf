"""A Spark-native document analytics engine."""
