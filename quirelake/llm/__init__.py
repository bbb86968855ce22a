"""Operators over texts and vectors for training data. Nothing outside this package imports it."""
