"""Column expressions: number, date and text cleaning, ratios, labels and classification."""
