"""Operators for preparing training data: chat formatting, searches, scans, extraction, dedup, tokens, filters, mixing, scoring, fingerprints."""
