"""PySpark-native engine that builds and mines retrieval training data."""
