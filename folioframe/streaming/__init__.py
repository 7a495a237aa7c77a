"""Structured Streaming jobs over repeated observations."""
