"""Quillgraph: a Spark-native analytics engine for versioned knowledge graphs."""
