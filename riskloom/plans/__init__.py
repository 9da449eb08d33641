"""Bindings of the operators to concrete tables."""
