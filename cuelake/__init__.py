"""Transcript-corpus analytics as PySpark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
