"""Operators for text and training data. Nothing outside this folder imports it."""
