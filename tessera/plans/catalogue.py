"""Queries and SQL of the core."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("operators.instants", "operators.versions", "operators.merges", "operators.relations", "operators.reports", "operators.texts", "operators.records", "operators.grammar", "operators.access", "operators.pages", "operators.payloads", "sources.stores")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"tessera.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")


def FLAGSHIP(spark, sf_dir: str):  # noqa: ANN001, ANN201, N802
    """Holdout cases by the sentences that also stand in a dev case."""
    return queries()["sentence_matches"](spark, sf_dir)
