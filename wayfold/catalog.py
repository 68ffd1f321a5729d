"""All queries of the library outside the training-data subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import card_queries, feed_queries, lexicon_queries, match_queries, more_queries, page_queries, scalar_queries, table_queries, venue_queries

_PARTS = (scalar_queries, table_queries, more_queries, venue_queries, feed_queries, card_queries, page_queries, lexicon_queries, match_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
FLAGSHIP = "nearest_suppliers"
