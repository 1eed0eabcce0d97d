"""PySpark-native representation-quality analytics over labelled signals."""
