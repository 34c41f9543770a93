"""The turn queries and their SQL, by name."""

from __future__ import annotations

from turnloom.plans import table_queries, turn_queries

QUERIES: dict = {**turn_queries.QUERIES, **table_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**turn_queries.SQL, **table_queries.SQL}
FLAGSHIP = "turn_handoff"
