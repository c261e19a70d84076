"""Structured Streaming forms of the windowed and keyed operators."""
