"""Operators of a training-data pipeline: deduplication, decontamination, tokens, extraction, quality, personal data."""
