"""Operators for preparing training data: deduplication, joins, tokens, language, mixing, fingerprints."""
