"""PySpark-native bibliographic and archival data-quality engine."""
