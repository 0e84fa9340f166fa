"""Operators for preparing language-model training text, as Spark jobs."""
