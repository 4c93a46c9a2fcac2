"""Readers, normalisation into pages and surfaces, and sinks."""
