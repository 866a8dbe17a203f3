"""Readers, writers and the derived venue tables."""
