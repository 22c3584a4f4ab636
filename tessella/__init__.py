"""Tessella: document and entity analytics as Spark DataFrame plans."""
