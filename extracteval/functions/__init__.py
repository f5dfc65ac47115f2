"""Column expressions: normalising, parsing, hashing, and the fixed value tables."""
