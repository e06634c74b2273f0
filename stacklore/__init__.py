"""Spark-first analytics over record metadata: cleaning, co-occurrence graphs,
association rules, text statistics, vectors, and quality checks."""

__version__ = "0.1.0"
