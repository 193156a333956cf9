"""Operators of a training-data pipeline: dedup, language, extraction, tokens, media, mixing, quality."""
