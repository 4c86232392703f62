"""Evidence search and ranking over code, documentation, history and reports, as Spark DataFrames."""

__version__ = "0.1.0"
