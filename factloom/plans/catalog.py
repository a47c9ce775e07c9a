"""The registered queries of the engine, each over whole tables, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_briefs, catalog_decisions, catalog_facts, catalog_more, catalog_pairs, catalog_rules, catalog_sources, catalog_state

FLAGSHIP = "c13_bounded_expansion"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (catalog_facts, catalog_pairs, catalog_rules, catalog_more, catalog_sources, catalog_state, catalog_decisions, catalog_briefs):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
