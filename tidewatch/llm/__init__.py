"""Operators of a training-data pipeline: text quality, duplicates, leaks, personal data, packing, archives."""
