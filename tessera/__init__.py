"""Tessera: workspace indexing, retrieval, SQL and analytics as PySpark plans."""

__version__ = "0.1.0"
