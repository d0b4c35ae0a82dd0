"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from lithoflow.llm import chat, decontaminate, exact, langid, licenses, mix, near, quality, repeats, tokens

MODULES = (exact, tokens, decontaminate, mix, licenses, langid, repeats, chat, quality, near)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
