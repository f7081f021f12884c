"""All registered queries."""

from __future__ import annotations

from tokenloom.plans import queries_align, queries_corpus, queries_scores, queries_vocab  # noqa: F401
from tokenloom.plans.registry import ORACLES, QUERIES

FLAGSHIP = "labelled_corpus_summary"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
