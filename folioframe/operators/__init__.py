"""Merges, appends, range reads, curation, windows and rankings."""
