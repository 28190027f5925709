"""Operators of a training-data pipeline: duplicates, language, quality, mixing, tokens."""
