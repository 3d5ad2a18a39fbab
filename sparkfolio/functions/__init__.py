"""Column functions: text, MIME types, search terms, model files."""
