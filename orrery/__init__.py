"""orrery: a PySpark-native engine for dynamic attributed networks and corpus preparation."""
