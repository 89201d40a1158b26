"""Column functions: geometry, court predicates, scores and text."""
