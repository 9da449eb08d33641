"""Readers, writers and table publication."""
