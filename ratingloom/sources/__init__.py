"""Readers, writers and the canonical views over the given tables."""
