"""Column functions: array mathematics, text, audio lengths."""
