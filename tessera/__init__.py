"""PySpark-native engine for candidate evaluation and experiment analytics."""
