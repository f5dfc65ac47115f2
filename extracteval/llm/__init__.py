"""Operators of a training-data pipeline over very large document collections.

Nothing else in the library imports this package. ``queries`` registers one query per operator."""
