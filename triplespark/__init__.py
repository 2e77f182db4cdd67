"""A PySpark-native engine for querying knowledge graphs stored as triples."""
