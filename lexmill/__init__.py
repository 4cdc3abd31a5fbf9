"""Corpus text analytics as Spark DataFrame plans."""
