"""Queries over the benchmark tables, and the same questions in SQL."""
