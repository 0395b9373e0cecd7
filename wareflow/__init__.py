"""Retail operations analytics as parameterised PySpark DataFrame operators."""
