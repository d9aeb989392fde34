"""Incremental counts."""
