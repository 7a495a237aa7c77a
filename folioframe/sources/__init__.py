"""Payload readers, file scans and generated dimensions."""
