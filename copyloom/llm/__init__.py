"""Operators for preparing language-model training data; nothing else in copyloom imports this package."""
