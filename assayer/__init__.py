"""assayer: a PySpark-native engine for curating and evaluating post-training data."""

__version__ = "0.1.0"
