"""A Spark-native engine for libraries of long documents."""
