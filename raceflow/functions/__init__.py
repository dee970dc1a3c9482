"""Column expressions: text cleaning, bands, derived measures."""
