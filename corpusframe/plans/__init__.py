"""Queries by name, the tool facade, validation and rendering."""
