"""Column expressions: text, statistics and vector arithmetic."""
