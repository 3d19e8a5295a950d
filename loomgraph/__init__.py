"""Loomgraph: a Spark-native engine for narrative knowledge graphs."""

__version__ = "0.1.0"
