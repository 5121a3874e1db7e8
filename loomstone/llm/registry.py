"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from loomstone.llm import alignment, chat, decontam, hostrules, infilling, lines, mixing, nearsets, pii, quality, secrets, tokens, vectors

MODULES = (lines, decontam, secrets, mixing, nearsets, pii, quality, tokens, vectors, chat, infilling, hostrules, alignment)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
