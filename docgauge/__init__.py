"""docgauge: a PySpark-native engine that measures document collections and keeps the evidence."""

__version__ = "0.1.0"
