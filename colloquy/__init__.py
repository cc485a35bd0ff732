"""Colloquy: a Spark-first engine for curating conversation and document corpora."""

__version__ = "0.1.0"
