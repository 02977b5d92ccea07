"""Queries and SQL of the subpackage. Importing it imports all operators, so a missing package of theirs shows here."""

from __future__ import annotations

from tessera.llm import boilerplate, near_duplicates, packing, reading_level, residue, split_overlap, tokens

MODULES = (boilerplate, near_duplicates, residue, split_overlap, tokens, packing, reading_level)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
