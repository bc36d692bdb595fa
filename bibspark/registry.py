"""Registered queries over the driver's tables, and the equivalent DuckDB SQL."""

from __future__ import annotations

from bibspark.plans import family_queries, more_queries, queries, roundtrip_queries, state_queries  # noqa: F401  all add to the same tables

QUERIES: dict = queries.QUERIES
ORACLES: dict[str, str] = queries.ORACLES
