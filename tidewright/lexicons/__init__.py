"""Fixed word lists, patterns and lookup tables."""
