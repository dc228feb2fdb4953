"""A Spark-native engine for functional, strongly typed queries."""
