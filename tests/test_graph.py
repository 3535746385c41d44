import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.errors import GraphLimitExceeded, NotFound
from corvane.operators import entities, graph

EDGE = "edge_id string, source_node_id string, target_node_id string, relation_type string, weight float"


def vertices(spark, *ids):
    return spark.createDataFrame([(i, i.title(), "t", [float(k), 0.0]) for k, i in enumerate(ids)], "entity_id string, name string, entity_type string, name_vector array<float>")


def edges(spark, *rows):
    return spark.createDataFrame([(f"{s}>{t}", s, t, r, w) for s, r, t, w in rows], EDGE)


def seed(spark, i):
    return spark.createDataFrame([(0, i)], "query_id int, entity_id string")


def ids(df, c="entity_id"):
    return sorted(r[c] for r in df.collect())


CHAIN = (("alice", "knows", "bob", 0.9), ("bob", "works_at", "acme", 0.8))


def test_depth_and_relation(spark):
    v, e = vertices(spark, "alice", "bob", "acme"), edges(spark, *CHAIN)
    near = graph.query_graph(v, e, seed(spark, "alice"), 2)
    assert ids(near.vertices) == ["acme", "alice", "bob"] and near.edges.count() == 2
    assert ids(graph.query_graph(v, e, seed(spark, "alice"), 1).vertices) == ["alice", "bob"]
    assert ids(graph.query_graph(v, e, seed(spark, "alice"), 2, "works_at").vertices) == ["acme", "bob"]
    assert graph.query_graph(v, e, seed(spark, "alice"), 2, "none").vertices.count() == 0


def test_patterns_and_direction(spark):
    v, e = vertices(spark, "a", "b", "c"), edges(spark, ("a", "knows", "b", 1.0), ("c", "knows", "b", 1.0))
    assert ids(graph.confirmed(v, e, seed(spark, "a"), 2)) == ["b"]
    assert ids(graph.confirmed(v, e, seed(spark, "b"), 1)) == ["a", "c"]
    assert graph.confirmed(v, e, seed(spark, "x"), 2).count() == 0
    v, e = vertices(spark, "alice", "bob", "acme"), edges(spark, ("alice", "knows", "bob", 1.0), ("alice", "founded_by", "acme", 1.0))
    assert ids(graph.fixed_hop(v, e, seed(spark, "alice")), "relation_type") == ["founded_by", "knows"]
    assert ids(graph.fixed_hop(v, e, seed(spark, "alice"), "founded_by")) == ["acme"]


def test_limits_are_errors(spark):
    v, e = vertices(spark, "hub"), edges(spark, *(("hub", "r", f"n{i}", 1.0) for i in range(12)))
    with pytest.raises(GraphLimitExceeded):
        graph.neighbourhood(v, e, seed(spark, "hub"), 1, max_edges=11)
    with pytest.raises(GraphLimitExceeded):
        graph.neighbourhood(v, e, seed(spark, "hub"), 1, max_frontier=11)
    assert graph.neighbourhood(v, e, seed(spark, "hub"), 1, max_edges=12, max_frontier=12).edges.count() == 12


def test_facts_keep_their_orientation(spark):
    v, e = vertices(spark, "carol", "dave"), edges(spark, ("carol", "mentors", "dave", 0.75))
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<float>")
    found = graph.facts(v, e, graph.nearest_seed(v, q, 0.5)).withColumn("fact", graph.render_fact()).collect()
    assert [(r.entity_a, r.entity_b, r.score, r.fact) for r in found] == [("Carol", "Dave", 0.75, "Carol —mentors→ Dave")]
    assert graph.nearest_seed(v, spark.createDataFrame([(0, [9.0, 9.0])], "query_id int, vector array<float>"), 0.5).count() == 0


def test_seed_by_name(spark):
    v = vertices(spark, "b", "a").withColumn("name", graph.F.lit(" Same\n"))
    assert graph.seed_by_name(v, "same ") == "a"
    with pytest.raises(NotFound):
        graph.seed_by_name(v, "other")
    assert graph.dangling(edges(spark, ("a", "r", "z", 1.0)), v).first().missing == "z"


def test_entities_resolve_and_relations_stay_in_their_chunk(spark):
    key = "document_id string, chunk_id string, chunk_index int, pos int"
    named = spark.createDataFrame([("d", "d:0", 0, 0, " Alice ", "person"), ("d", "d:0", 0, 1, "Acme", "org"), ("d", "d:1", 1, 0, "ALICE", "thing")], f"{key}, name string, entity_type string")
    known = spark.createDataFrame([("k1", "acme", "company", ["x:0"])], "entity_id string, name string, entity_type string, source_chunk_ids array<string>")
    out = {r.folded: r for r in entities.resolve(named, known).collect()}
    assert out["alice"].name == " Alice " and out["alice"].source_chunk_ids == ["d:0", "d:1"] and out["alice"].is_new
    assert (out["acme"].entity_id, out["acme"].entity_type, out["acme"].source_chunk_ids) == ("k1", "company", ["x:0", "d:0"])
    related = spark.createDataFrame([("d", "d:0", 0, 0, "alice", "ACME", "works_at", 0.5), ("d", "d:1", 1, 0, "alice", "acme", "works_at", 0.5)], f"{key}, source string, target string, relation_type string, confidence float")
    resolved = entities.resolve(named, known)
    assert [r.edge_id for r in entities.mapped_relations(related, named, resolved).collect()] == ["d:0:rel:0"]
    assert [r.chunk_id for r in entities.unmapped_relations(related, named).collect()] == ["d:1"]


def test_adjacency_gives_the_same_and_moves_the_frontier_alone(spark):
    rows = [(f"v{k}", "knows" if k % 2 else "likes", f"v{(k * 7 + 3) % 40}", 1.0) for k in range(60)] + [("v1", "self", "v1", 1.0)]
    v, e = vertices(spark, *[f"v{k}" for k in range(60)]), edges(spark, *rows)
    kept = graph.adjacency(e)
    start = seed(spark, "v1").union(spark.createDataFrame([(1, "v12"), (2, "none")], "query_id int, entity_id string"))
    free = {"max_edges": None, "max_frontier": None}
    for hops in (1, 2, 3):
        plain, own = graph.neighbourhood(v, e, start, hops, **free), graph.neighbourhood(v, kept, start, hops, **free)
        for a, b in zip(plain, own, strict=True):
            key = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
            assert key(a) == key(b)
        assert sorted(map(tuple, graph.confirmed(v, e, start, hops).collect())) == sorted(map(tuple, graph.confirmed(v, kept, start, hops).collect()))
    assert sorted(map(tuple, graph.fixed_hop(v, e, start, "knows").select("query_id", "entity_id", "relation_type").collect())) == sorted(map(tuple, graph.fixed_hop(v, kept, start, "knows").select("query_id", "entity_id", "relation_type").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = kept.by_end.join(start, "entity_id").select("query_id", *graph.EDGE)
        executed = hop._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = next(k for k, line in enumerate(executed.splitlines()) if "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines, parents, at = executed.splitlines(), [], scan
    for k in range(scan - 1, -1, -1):
        if depth(lines[k]) < depth(lines[at]):
            parents.append(lines[k])
            at = k
    join = next(k for k, line in enumerate(parents) if "Join" in line)
    assert "Exchange" in executed and not any("Exchange" in line for line in parents[:join])


def test_summaries_stand_for_facts(spark):
    v = vertices(spark, "a", "b", "c")
    e = edges(spark, ("a", "r", "b", 0.5), ("a", "r", "c", 0.5)).withColumn("summary", F.when(F.col("target_node_id") == "b", "<i> of b"))
    found = graph.facts(v, e, spark.createDataFrame([(0, "a", 1.0)], "query_id int, entity_id string, score double"))
    assert sorted(r[0] for r in found.select(graph.render_fact("summary")).collect()) == ["&lt;i&gt; of b", "A —r→ C"]


def test_digests_of_chunk_ids_without_lists(spark):
    rows = [(f"d{k % 7}", f"d{k % 7}:{k % 401}", k % 401, k, [" Acme", "ACME\t", "other"][k % 3], "t") for k in range(3000)] + [("x", "x:0", 0, 0, "only known", "t"), ("x", None, 1, 0, "acme", "t")]
    found = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index int, pos int, name string, entity_type string")
    known = spark.createDataFrame(
        [("k1", "acme", "company", ["x:9", "d3:3", "x:9"]), ("k2", "Acme", "company", ["y"]), ("k3", "nobody", "p", ["z"]), ("k4", "only known", "p", ["x:0"])], "entity_id string, name string, entity_type string, source_chunk_ids array<string>"
    )
    listed = {r.folded: r.source_chunk_ids for r in entities.resolve(found, known).collect()}
    digests = entities.chunk_digests(found, known)
    got = {r.folded: (r.n_chunks, r.chunks_md5) for r in digests.collect()}
    assert got == {name: (len(ids), hashlib.md5(",".join(x for x in ids if x is not None).encode()).hexdigest()) for name, ids in listed.items()}
    assert set(got) == {"acme", "other", "only known"} and got["only known"][0] == 1 and got["acme"][0] > 2 * entities.IDS_TOGETHER
    assert "collect_" not in digests._jdf.queryExecution().toString()


def test_seeds_meet_the_vectors_once(spark):
    v = vertices(spark, "a", "b", "c")
    q = spark.createDataFrame([(0, [0.9, 0.0]), (1, [1.9, 0.0])], "query_id int, vector array<float>")
    start = graph.nearest_seed(v, q, 0.1)
    assert sorted((r.query_id, r.entity_id) for r in start.collect()) == [(0, "b"), (1, "c")]
    assert "MapInArrow" not in start._jdf.queryExecution().toString()
