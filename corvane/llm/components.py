"""Connected components by alternating large-star and small-star steps.

Each step points nodes at the smallest node they can see; the edges end as
stars around the smallest node of each component. Every step is a group-by
(pre-aggregated before its shuffle) and an equi-join whose two sides are plain
exchanges over stored tables, so a hub's partition can be split at run time.
Nothing is gathered on the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.storage import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _least(spark: SparkSession, edges: DataFrame) -> DataFrame:
    return materialise(spark, edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    ``links``: columns ``a`` and ``b`` (long). Returns ``node`` and
    ``component`` (the component's smallest node) for every node that some link
    joins to another one. Links with a null end or from a node to itself add
    nothing; repeated links count once; no links give no rows.
    """
    ends = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    proper = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialise(spark, proper.select(*ends).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(spark, both)
        large = materialise(
            spark, both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        discard(spark, least)
        least = _least(spark, large)
        joined = large.join(least, "u")
        small = materialise(
            spark,
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct(),
            "small",
        )
        discard(spark, least, large, edges)
        edges, before = small, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
