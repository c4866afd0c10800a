"""Operators for preparing training data: deduplication, extraction, quality, mixing and encoding."""
