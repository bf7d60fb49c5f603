"""Faceted search, lineage and data-quality engine over entity graphs, on Spark DataFrames."""

__version__ = "0.1.0"
