"""Spark operators for curating, featurizing, pairing and scoring tables of
literature measurements.  Every operator maps DataFrames to DataFrames."""

__version__ = "0.1.0"
