"""Column functions: text, SQL text, model answers, seeded choices, similarity."""
