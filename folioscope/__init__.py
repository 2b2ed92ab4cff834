"""A Spark-native query engine for document archives."""
