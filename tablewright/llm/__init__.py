"""Operators for building training corpora. Nothing else in tablewright imports this package."""
