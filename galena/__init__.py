"""galena: a PySpark-native analytics engine for typed property graphs of code and data."""

__version__ = "0.1.0"
