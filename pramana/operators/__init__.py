"""Operators of the document-evidence engine."""
