"""A PySpark-native retrieval, ranking and evaluation engine for text corpora."""
