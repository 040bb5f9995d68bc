"""Loomstead: a Spark-native engine for document ontologies, retrieval and arbitration of competing claims."""
