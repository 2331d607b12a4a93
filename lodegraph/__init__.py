"""lodegraph: a Spark-native repository-intelligence engine."""
