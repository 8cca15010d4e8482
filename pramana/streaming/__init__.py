"""Streaming of the document-evidence engine."""
