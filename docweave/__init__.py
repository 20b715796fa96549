"""Evidence retrieval, entity resolution and dataset building over document collections, on Spark."""
