"""Dataset dependency analysis and leakage-aware split design on Spark DataFrames."""

__version__ = "0.1.0"
