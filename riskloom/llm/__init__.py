"""Operators for training data: quality, mixing, filters, sharding, packing, duplicates, scoring, chat, fingerprints.

Nothing outside this package imports it; ``queries`` registers one query per operator.
"""
