"""A PySpark-native engine for dialect queries and for SQL text as data."""
