"""granary: a Spark-native engine for the data side of a document knowledge base."""
