"""Registered queries with their independent DuckDB statements."""

from __future__ import annotations

from importlib import import_module

_FAMILIES = ("rows", "collab", "evaluation", "diagnosis", "training", "ratings", "files", "texts", "hybrids")


def _collect(what: str) -> dict:
    found: dict = {}
    for family in _FAMILIES:
        found.update(getattr(import_module(f"{__name__}.{family}"), what))
    return found


def registered_queries() -> dict:
    return _collect("QUERIES")


def oracle_statements() -> dict:
    return _collect("ORACLES")
