"""riskweave: Spark-native time-series risk analytics."""

__version__ = "0.1.0"
