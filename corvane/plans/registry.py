"""All queries over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import answers, graphs, retrieval, states, workflows

MODULES = (retrieval, graphs, answers, states, workflows)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
