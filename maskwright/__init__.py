"""maskwright: a Spark-native engine that finds, redacts, reversibly replaces and restores personal data in text."""

__version__ = "0.1.0"
