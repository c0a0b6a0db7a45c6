"""Importers, record files and text sinks."""
