"""quillgraph: a PySpark-native engine for text knowledge graphs and trend analytics."""
