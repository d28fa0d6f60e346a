"""quillmill: a Spark-native engine for usage logs of coding agents and for preparing training data."""

__version__ = "0.1.0"
