"""Operators on text and records for training corpora. Nothing else in the package imports this."""
