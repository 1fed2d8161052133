"""logloom: a keyed-log engine on PySpark DataFrames."""

__version__ = "0.1.0"
