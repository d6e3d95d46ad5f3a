"""Column functions: text, hashes, cells, distances."""
