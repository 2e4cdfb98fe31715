"""A PySpark-native seller-risk analytics engine."""
