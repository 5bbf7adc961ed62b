"""Parsers of external formats, and writers of generated documents."""
