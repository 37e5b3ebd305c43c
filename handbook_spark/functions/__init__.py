"""Column expressions over texts, URLs, nested values, dates, scores and vectors."""
