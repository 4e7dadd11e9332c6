"""Spark-first engine for the operational history of software agents."""

__version__ = "0.1.0"
