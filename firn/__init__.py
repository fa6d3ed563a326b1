"""firn: event-summary analysis on PySpark DataFrames."""

__version__ = "0.1.0"
