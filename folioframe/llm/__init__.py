"""Operators for preparing training data: scanning, scoring, deduplicating, formatting, packing and searching."""
