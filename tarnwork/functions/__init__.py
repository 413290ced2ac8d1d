"""Column expressions: text normalization, similarity and parsing."""
