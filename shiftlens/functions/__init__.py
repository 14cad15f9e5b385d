"""Column expressions: predicates, text, paths and number formatting."""
