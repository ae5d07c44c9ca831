"""A Spark-native engine for batch knowledge retrieval and document processing."""
