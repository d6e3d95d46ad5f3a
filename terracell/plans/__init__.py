"""Queries over the driver tables, by topic, with their SQL."""
