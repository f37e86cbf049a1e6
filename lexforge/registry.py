"""All registered queries of the core library, and their DuckDB oracles."""

from __future__ import annotations

from lexforge.plans import analytics, answers, evaluation, graphs, indexes, pages, retrieval, search, storage, streams

QUERIES: dict = {}
ORACLES: dict = {}
for _plans in (retrieval, analytics, answers, storage, evaluation, search, indexes, streams, graphs, pages):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
FLAGSHIP = "bm25_search"
