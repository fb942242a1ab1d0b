"""Registered queries and their SQL twins."""

from __future__ import annotations

from . import corpus, search

QUERIES = {**corpus.QUERIES, **search.QUERIES}
ORACLES = {**corpus.ORACLES, **search.ORACLES}
FLAGSHIP = "ans9_answers"
