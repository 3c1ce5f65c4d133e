"""Readers and writers of RDF syntaxes, table mappings and the quad store."""
