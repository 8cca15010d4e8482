"""Sources of the document-evidence engine."""
