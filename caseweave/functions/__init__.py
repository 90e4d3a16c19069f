"""Column expressions: missing-value rules, recoding, text and dates."""
