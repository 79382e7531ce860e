"""Corpus analytics over linked notes, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
