"""Registers all queries of this folder."""

from __future__ import annotations

from tokenloom.llm import queries_corpus, queries_sets, queries_text  # noqa: F401
from tokenloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
