"""Column functions: text, encodings, hashes."""
