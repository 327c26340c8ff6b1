"""veta: tabular mining and regression operators for Spark DataFrames."""

__version__ = "0.1.0"
