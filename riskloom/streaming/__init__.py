"""Incremental execution of row-local operators."""
