"""Registered queries of the core, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans import graphs, listings, problem5, ranking

MODULES = [ranking, listings, graphs, problem5]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.q_bm25(spark, sf_dir)
