"""tallymark: Spark-native table verification."""

__version__ = "0.1.0"
