"""Operators of a training-data pipeline over text corpora; nothing outside this package imports it."""
