"""Operators of a training-data pipeline: tokens, near copies, search, language, extraction, quality, mixing, secrets."""
