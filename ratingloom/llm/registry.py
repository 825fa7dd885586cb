"""Queries of the training-data operators and the pipeline, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("chat", "quality_rules", "secret_scan", "near_dedup", "quality_cnn", "toxicity", "packing", "decontaminate", "suffix_repeats",
            "phrase_automata", "vector_codes", "lexical_search",
            "lm_scoring")


def _collect(what: str) -> dict:
    found: dict = {}
    for name in _MODULES:
        found.update(getattr(import_module(f"ratingloom.llm.{name}"), what))
    return found


def registered_queries() -> dict:
    return _collect("QUERIES")


def oracle_statements() -> dict:
    return _collect("ORACLES")
