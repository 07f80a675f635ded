"""Structural-variant evidence on Spark: signals, calls, comparison and consensus as DataFrames."""

__version__ = "0.1.0"
