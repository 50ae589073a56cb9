"""crucible: a Spark-native engine for molecular and tabular compound data."""

__version__ = "0.1.0"
