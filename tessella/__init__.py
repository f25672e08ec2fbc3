"""A PySpark-native analytics engine: declarative requests compiled to DataFrames."""

__version__ = "0.1.0"
