"""Column functions: analysis of text, paths and source lines."""
