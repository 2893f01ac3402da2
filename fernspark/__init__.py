"""fernspark: a Spark-native engine for aggregated listings."""
