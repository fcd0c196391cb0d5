"""tidemark: point-in-time analytics on Spark, as plain DataFrame -> DataFrame functions."""

__version__ = "0.1.0"
