"""tessella: retrieval and analytics over text and feature vectors, on Spark DataFrames."""

__version__ = "0.1.0"
