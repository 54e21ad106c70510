"""Queries over tables, with their SQL twins."""
