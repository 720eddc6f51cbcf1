"""Column expressions: text cleaning, safe parsing, hashing and the sales vocabulary."""
