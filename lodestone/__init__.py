"""Lodestone: a relational table engine and data toolkit on PySpark."""

__version__ = "0.1.0"
