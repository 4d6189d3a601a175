"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import corpus_queries, detail_queries, ontology_queries, research_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**ontology_queries.QUERIES, **corpus_queries.QUERIES, **research_queries.QUERIES, **detail_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**ontology_queries.ORACLE, **corpus_queries.ORACLE, **research_queries.ORACLE, **detail_queries.ORACLE}
