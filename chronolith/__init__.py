"""chronolith: a point-in-time analytics engine on PySpark DataFrames."""

__version__ = "0.1.0"
