"""A PySpark-native engine for knowledge-graph question answering and retrieval analytics."""
