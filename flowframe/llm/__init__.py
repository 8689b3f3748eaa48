"""Operators for preparing training corpora: deduplication, scans, mixing, search, archives, tokens."""
