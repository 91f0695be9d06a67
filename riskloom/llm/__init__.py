"""Operators of a training-data pipeline (mixing, tokens, dedup, quality, safety)."""
