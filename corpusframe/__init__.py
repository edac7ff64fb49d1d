"""A PySpark-native search and corpus-analytics engine."""
