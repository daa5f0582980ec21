"""Structured-note analytics as Spark plans."""
