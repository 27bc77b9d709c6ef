"""Code-index and retrieval engine expressed as PySpark DataFrame jobs."""

__version__ = "0.1.0"
