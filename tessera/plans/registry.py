"""All registered queries of the entity-resolution part."""

from __future__ import annotations

from tessera.plans import audit_queries, er_queries, pair_queries, report_queries  # noqa: F401  (registers its queries)

QUERIES = dict(er_queries.QUERIES)
ORACLE_SQL = dict(er_queries.ORACLE_SQL)
