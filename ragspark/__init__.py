"""A PySpark-native engine for literature retrieval and evaluation."""
