"""All registered queries and their SQL twins."""

from __future__ import annotations

from webloom.plans import crawling, extraction, graphs, languages, linkage, searching, streams

_PLANS = (extraction, linkage, graphs, languages, searching, crawling, streams)

QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: text for plan in _PLANS for name, text in plan.ORACLES.items()}
