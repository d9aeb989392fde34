"""Expressions on sequences, records and numbers."""
