"""Paired-panel analytics on Spark: ingest, pair, score and test survey panels."""

__version__ = "0.1.0"
