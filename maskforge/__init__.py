"""maskforge: Spark-native feature-subset search, scoring and reporting."""
