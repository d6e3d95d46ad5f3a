"""Readers of input tables and feeds."""
