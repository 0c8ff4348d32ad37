"""Operators for large text and embedding corpora, each a DataFrame -> DataFrame function."""
