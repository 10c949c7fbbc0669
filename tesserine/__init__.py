"""Corpus retrieval and data processing as ordinary Spark DataFrame jobs."""

__version__ = "0.1.0"
