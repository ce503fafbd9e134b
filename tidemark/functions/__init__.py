"""Column expressions: guarded arithmetic, labels, text and tokens, dates, distributions."""
