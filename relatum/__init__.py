"""Relational-context analytics over file catalogs, expressed as Spark DataFrames."""

__version__ = "0.1.0"
