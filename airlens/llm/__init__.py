"""Operators for preparing training data: packing, deduplication, tokens, classifiers, sharding, personal data."""
