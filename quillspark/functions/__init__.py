"""Column functions: text, citations and vectors."""
