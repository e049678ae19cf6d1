"""All queries of the sensor engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import functions_queries, fusion_queries, record_queries, source_queries, stage_queries, validator_queries, window_queries

MODULES = (functions_queries, validator_queries, stage_queries, window_queries, fusion_queries, source_queries, record_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings validated in one pass, then hourly figures of each kind."""
    return window_queries.hourly_validated(spark, sf_dir)
