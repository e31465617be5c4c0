"""Queries over the driver's tables, each with the same result in SQL."""
