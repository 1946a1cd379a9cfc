"""All registered queries and their SQL."""

from __future__ import annotations

from . import claims, curation, evidence, gates, metrics, requirements, retrieval, segments, session, verification

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (retrieval, metrics, curation, evidence, segments, claims, gates, verification, session, requirements):
    QUERIES.update(_part.QUERIES)
    SQL.update(_part.SQL)
