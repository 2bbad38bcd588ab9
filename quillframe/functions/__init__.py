"""Column functions: box geometry, label vocabulary, intervals."""
