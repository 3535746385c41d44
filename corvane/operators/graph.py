"""Bounded traversal and pattern matching on an entity graph, for many seeds at once.

Edges: ``edge_id, source_node_id, target_node_id, relation_type, weight``; vertices:
``entity_id, name, entity_type``; seeds: ``query_id, entity_id``. A condition on either end of an edge is
the union of two equi-joins, never a join on OR.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.errors import GraphLimitExceeded, NotFound
from corvane.functions.text import escape_markup, fold_name
from corvane.operators.dense import dense_score, distances
from corvane.operators.lexical import DECIMALS
from corvane.settings import MAX_EDGES, MAX_FRONTIER, MAX_RELATION_BYTES, MAX_SEED_NAME_BYTES, bounded, hop_limit
from corvane.sources.shared import shared_dir, stored

# Facts in words.
FACT_FORMS = {"arrow": "%s —%s→ %s", "dashes": "%s -- %s -- %s"}
EDGE = ("edge_id", "source_node_id", "target_node_id", "relation_type", "weight")


class Neighbourhood(NamedTuple):
    """``vertices``: query_id, entity_id, and the vertex's columns; ``edges``: query_id and the edge's columns."""

    vertices: DataFrame
    edges: DataFrame


class Adjacency(NamedTuple):
    """Edges, and ``by_end``: each once for each of its ends as ``entity_id``, in files by a hash of it, so that a hop moves its frontier alone."""

    edges: DataFrame
    by_end: DataFrame


#: Rows of a bucket of an adjacency; there are as many buckets as shuffle partitions at least, as Spark else moves both sides.
ROWS_A_BUCKET, MOST_BUCKETS = 4_000_000, 1 << 15


def adjacency(edges: DataFrame, columns: tuple[str, ...] = EDGE) -> Adjacency:
    """Store edges by both of their ends, sorted within buckets. An edge from a vertex to itself stands once."""
    spark = edges.sparkSession
    kept = stored(edges, "edges")
    ends = F.explode(F.array_distinct(F.array("source_node_id", "target_node_id")))
    rows = kept.select(ends.alias("entity_id"), *columns)
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * kept.count() // ROWS_A_BUCKET))
    name = f"corvane_adjacency_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/corvane/{name}"
    # one file a bucket
    rows.repartition(buckets, "entity_id").write.bucketBy(buckets, "entity_id").sortBy("entity_id").option("path", path).saveAsTable(name)
    return Adjacency(kept, spark.table(name))


def touching(edges: DataFrame | Adjacency, ids: DataFrame) -> DataFrame:
    """``query_id`` and edges of which an end is among ``ids`` (``query_id, entity_id``), each once."""
    if isinstance(edges, Adjacency):
        return edges.by_end.join(ids, "entity_id").select("query_id", *EDGE).distinct()
    by = [edges.join(ids.withColumnRenamed("entity_id", end), end).select("query_id", *EDGE) for end in ("source_node_id", "target_node_id")]
    return by[0].union(by[1]).distinct()


def ends(edges: DataFrame) -> DataFrame:
    return edges.select("query_id", F.explode(F.array("source_node_id", "target_node_id")).alias("entity_id")).distinct()


def _over(rows: DataFrame, most: int, what: str) -> DataFrame:
    """``query_id, message`` of the queries that have more rows than allowed."""
    counts = rows.groupBy("query_id").count().where(F.col("count") > most)
    return counts.select("query_id", F.format_string(f"%d {what}, more than {most}", "count").alias("message"))


def within_limits(edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, max_edges: int = MAX_EDGES, max_frontier: int = MAX_FRONTIER) -> tuple[DataFrame, DataFrame]:
    """The seeds whose traversal stays within the limits, and ``query_id, message`` of the others, which are left out from the hop on that is too large."""
    visited = frontier = seeds.select("query_id", "entity_id").distinct()
    found, over = None, None
    for hop in range(1, hop_limit(hops) + 1):
        near = stored(touching(edges, frontier), "hop")
        found = near if found is None else found.union(near).distinct()
        frontier = ends(near).join(visited, ["query_id", "entity_id"], "left_anti")
        worse = _over(found, max_edges, f"edges within {hop} hops").union(_over(frontier, max_frontier, f"new vertices at hop {hop}"))
        worse = stored(worse.groupBy("query_id").agg(F.min("message").alias("message")), "over")
        over = worse if over is None else over.union(worse)
        visited, frontier, found = (df.join(worse.select("query_id"), "query_id", "left_anti") for df in (visited.union(frontier), frontier, found))
    return seeds.join(over.select("query_id"), "query_id", "left_anti"), over


def _check(rows: DataFrame, most: int, what: str) -> None:
    worst = _over(rows, most, what).first()
    if worst:
        raise GraphLimitExceeded(f"query {worst['query_id']}: {worst['message']}")


def neighbourhood(vertices: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, max_edges: int | None = MAX_EDGES, max_frontier: int | None = MAX_FRONTIER) -> Neighbourhood:
    """What is within ``hops`` edges of each seed, in either direction.

    Edges are those that touch a vertex reached before the last hop. More distinct edges or new vertices of a hop
    than allowed for some seed is an error, also on the last hop. Each hop is stored, as the next ones and the result use it. A
    seed without a vertex row is traversed all the same.
    """
    visited = frontier = seeds.select("query_id", "entity_id").distinct()
    found = None
    for _ in range(hop_limit(hops)):
        hop = stored(touching(edges, frontier), "hop")
        found = hop if found is None else found.union(hop).distinct()
        frontier = ends(hop).join(visited, ["query_id", "entity_id"], "left_anti")
        if max_edges is not None:
            _check(found, max_edges, "edges")
        if max_frontier is not None:
            _check(frontier, max_frontier, "new vertices")
        visited = visited.union(frontier)
    return Neighbourhood(vertices.join(visited, "entity_id").select("query_id", *vertices.columns), found)


def _along(edges: DataFrame | Adjacency, backward: bool) -> DataFrame:
    """``entity_id, to``: the steps along the edges or against them."""
    one, other = ("target_node_id", "source_node_id") if backward else ("source_node_id", "target_node_id")
    if isinstance(edges, Adjacency):
        return edges.by_end.where(F.col("entity_id") == F.col(one)).select("entity_id", F.col(other).alias("to"))
    return edges.select(F.col(one).alias("entity_id"), F.col(other).alias("to"))


def walk(vertices: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, backward: bool = False) -> DataFrame:
    """``query_id, entity_id, hop`` of every directed path of 1 to ``hops`` edges whose vertices all exist; a row each."""
    steps = _along(edges, backward)
    known = vertices.select("entity_id")
    at, out = seeds.select("query_id", "entity_id").join(known, "entity_id", "left_semi"), None
    for hop in range(1, hops + 1):
        at = steps.join(at, "entity_id").select("query_id", F.col("to").alias("entity_id")).join(known, "entity_id", "left_semi")
        rows = at.withColumn("hop", F.lit(hop))
        out = rows if out is None else out.union(rows)
    return out


def fixed_hop(vertices: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, relation: str | None = None) -> DataFrame:
    """Pattern (seed)-[r]->(n): ``query_id, entity_id, relation_type``, a row for each edge; with ``relation`` only its edges."""
    chosen = edges.by_end.where(F.col("entity_id") == F.col("source_node_id")) if isinstance(edges, Adjacency) else edges.withColumn("entity_id", F.col("source_node_id"))
    chosen = chosen if relation is None else chosen.where(F.col("relation_type") == relation)
    known = vertices.select(F.col("entity_id"))
    rows = chosen.join(seeds.select("query_id", "entity_id"), "entity_id").drop("entity_id").join(known.withColumnRenamed("entity_id", "source_node_id"), "source_node_id", "left_semi")
    return rows.select("query_id", F.col("target_node_id").alias("entity_id"), "relation_type").join(known, "entity_id", "left_semi")


def confirmed(vertices: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, hops: int) -> DataFrame:
    """``query_id, entity_id`` that a path in one direction reaches, wholly forward or wholly backward."""
    forward = walk(vertices, edges, seeds, hops)
    backward = walk(vertices, edges, seeds, hops, backward=True)
    return forward.union(backward).select("query_id", "entity_id").distinct()


def narrow(near: Neighbourhood, seeds: DataFrame, allowed: DataFrame) -> Neighbourhood:
    """Only the seeds and allowed vertices, and edges of which both ends are among them."""
    ids = allowed.select("query_id", "entity_id").union(seeds.select("query_id", "entity_id")).distinct()
    keep = lambda df, c: df.join(ids.withColumnRenamed("entity_id", c), ["query_id", c], "left_semi")
    return Neighbourhood(keep(near.vertices, "entity_id"), keep(keep(near.edges, "source_node_id"), "target_node_id"))


def of_relation(near: Neighbourhood, relation: str) -> Neighbourhood:
    """Edges of one relation, and the vertices at their ends; a seed may vanish."""
    edges = near.edges.where(F.col("relation_type") == relation)
    return Neighbourhood(near.vertices.join(ends(edges), ["query_id", "entity_id"], "left_semi"), edges)


def query_graph(vertices: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, hops: int, relation: str | None = None, **limits) -> Neighbourhood:
    """The graph query: neighbourhood, narrowed to confirmed vertices, then to one relation."""
    if relation is not None:
        bounded(relation, MAX_RELATION_BYTES, "relation")
    near = neighbourhood(vertices, edges, seeds, hops, **limits)
    # a path of so many edges lies within the neighbourhood, so it can be looked for among all edges
    near = narrow(near, seeds, confirmed(vertices, edges, seeds, hops))
    return of_relation(near, relation) if relation else near


def seeds_by_name(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, entity_id``: of the vertices with that folded name the one of the smallest id. ``names``: query_id, name."""
    asked = names.select("query_id", fold_name(F.col("name")).alias("_folded"))
    rows = vertices.select("entity_id", fold_name(F.col("name")).alias("_folded")).join(asked, "_folded")
    return rows.groupBy("query_id").agg(F.min("entity_id").alias("entity_id"))


def seed_by_name(vertices: DataFrame, name: str) -> str:
    spark = vertices.sparkSession
    bounded(name, MAX_SEED_NAME_BYTES, "name")
    row = seeds_by_name(vertices, spark.createDataFrame([(0, name)], "query_id int, name string")).first()
    if row is None:
        raise NotFound(f"no entity is named {name!r}")
    return row["entity_id"]


def nearest_seed(vertices: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, entity_id, score`` of the vertex whose ``name_vector`` is nearest, if its score is ``least`` or more."""
    named = vertices.select("entity_id", F.col("name_vector").alias("embedding"))
    rows = distances(named, queries, ("entity_id",), 1).withColumn("distance", F.round("distance", DECIMALS))
    order = Window.partitionBy("query_id").orderBy("distance", "entity_id")
    best = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    # a traversal uses its seeds many times, and each would meet all vectors anew
    return stored(best.select("query_id", "entity_id", dense_score(F.col("distance")).alias("score")).where(F.col("score") >= least), "seeds")


def facts(vertices: DataFrame, edges: DataFrame | Adjacency, seeds: DataFrame, **limits) -> DataFrame:
    """Facts around each scored seed: one hop in either direction, narrowed, with names in place of ids.

    The orientation stays as stored; names are escaped here, once. Score: the seed's times the edge's weight.
    """
    near = query_graph(vertices, edges, seeds, 1, **limits)
    named = lambda id_, name: vertices.select(F.col("entity_id").alias(id_), escape_markup(F.col("name")).alias(name))
    rows = near.edges.join(named("source_node_id", "entity_a"), "source_node_id").join(named("target_node_id", "entity_b"), "target_node_id")
    rows = rows.join(seeds.select("query_id", F.col("score").alias("_seed")), "query_id")
    summary = F.lit(None).cast("string")
    every = edges.edges if isinstance(edges, Adjacency) else edges
    if "summary" in every.columns:
        rows, summary = rows.join(every.select("edge_id", F.col("summary").alias("_summary")), "edge_id", "left"), escape_markup(F.col("_summary"))
    return rows.select(
        "query_id", "edge_id", "entity_a", escape_markup(F.col("relation_type")).alias("relation_type"), "entity_b", summary.alias("edge_summary"),
        (F.col("_seed") * F.col("weight").cast("double")).alias("score"),
    )


def render_fact(form: str = "arrow"):
    """A fact in words: for the prompt (``arrow``), for a context line (``dashes``), or as the edge's summary where it has one (``summary``)."""
    words = F.format_string(FACT_FORMS["dashes" if form == "dashes" else "arrow"], "entity_a", "relation_type", "entity_b")
    return F.coalesce(F.col("edge_summary"), words) if form == "summary" else words


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edge_id, missing`` for each end of an edge that is no vertex; empty for a sound graph."""
    rows = edges.select("edge_id", F.explode(F.array("source_node_id", "target_node_id")).alias("entity_id"))
    return rows.join(vertices.select("entity_id"), "entity_id", "left_anti").select("edge_id", F.col("entity_id").alias("missing"))
