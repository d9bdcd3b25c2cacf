"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from docshield.plans import (access_queries, analytics_queries, dp_queries, extra_queries, ingest_queries,
                             pipeline_queries, stream_queries)

QUERIES = {}
ORACLE = {}
for _m in (ingest_queries, access_queries, dp_queries, pipeline_queries, analytics_queries, extra_queries,
           stream_queries):
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
