"""Livestock GPS analytics as declarative Spark DataFrame plans."""
