"""Millrace: data-quality, preparation and analytics operators for Spark DataFrames."""

__version__ = "0.1.0"
