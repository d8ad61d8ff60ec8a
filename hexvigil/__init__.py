"""Collective security intelligence as PySpark DataFrame jobs."""
