"""Reusable operators; each takes and returns DataFrames and states its grain."""
