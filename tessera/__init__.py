"""A Spark-native analytics engine for documents and knowledge graphs."""
