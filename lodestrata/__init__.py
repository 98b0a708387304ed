"""Lodestrata: vault, planning and training-data analytics as Spark plans."""
