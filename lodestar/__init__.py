"""lodestar: a PySpark-native analytics engine for star-schema and nested (correlated-subquery) SQL."""
