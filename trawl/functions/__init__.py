"""Column expressions: text analysis, vectors, ordering keys."""
