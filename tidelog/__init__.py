"""Commit-log analytics and change-data operators for PySpark DataFrames."""

__version__ = "0.1.0"
