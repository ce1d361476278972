"""Dialogue and minutes analytics as PySpark DataFrame operators."""
