"""Operators for preparing training data: language, quality, duplicates, secrets, personal data, tokens and packing."""
