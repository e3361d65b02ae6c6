"""A PySpark-native engine for collecting, classifying, deduplicating, scoring and selecting candidates."""
