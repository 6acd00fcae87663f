"""Column expressions: text cleaning, standardisation, distances."""
