"""orrery: a PySpark-native engine for corpus-scale quality, deduplication and evaluation work."""
