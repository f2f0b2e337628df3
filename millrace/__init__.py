"""millrace: Spark-native analytics for evidence-backed hiring signals."""

__version__ = "0.1.0"
