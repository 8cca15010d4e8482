"""Functions of the document-evidence engine."""
