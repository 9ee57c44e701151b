"""Column functions: text analysis, vectors, keyed hashes."""
