"""All queries of the library but for those of its optional subpackage, with their SQL."""

from __future__ import annotations

from rolemesh.plans import funnel_queries, grounding_queries, judging_queries, record_queries, review_queries, text_queries, vocabulary_queries

_PARTS = (funnel_queries, review_queries, judging_queries, text_queries, vocabulary_queries, grounding_queries, record_queries)
QUERIES = {k: q for part in _PARTS for k, q in part.QUERIES.items()}
ORACLES = {k: q for part in _PARTS for k, q in part.ORACLES.items()}
