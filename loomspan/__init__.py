"""A PySpark-native engine for time-series panels: DataFrame, SQL and Structured Streaming operators."""
