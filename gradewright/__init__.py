"""Benchmark curation and evaluation analytics as PySpark DataFrame operators."""
