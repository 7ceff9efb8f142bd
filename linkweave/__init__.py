"""linkweave: record linkage and corpus preparation as PySpark DataFrame programs."""

__version__ = "0.1.0"
