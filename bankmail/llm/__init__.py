"""Operators for training corpora: deduplication, personal data, mixing, packing, classifiers, joins."""
