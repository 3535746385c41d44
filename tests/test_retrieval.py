import random

import pytest

from corvane.errors import IndexBuildError, InvalidSettings, NonFiniteScore
from corvane.functions.analyze import unicode_terms
from corvane.operators import dense, fusion, lexical
from corvane.plans import retrieval, tables
from corvane.settings import Bm25Settings, Filters, RetrievalSettings

CHUNK = "document_id string, chunk_index int, chunk_id string, content string, title string, section_path string, content_type string"
LIST = "query_id int, variant int, source string, document_id string, chunk_index int, chunk_id string, score double"


def chunk(doc, i, content, kind="text/plain"):
    return (doc, i, f"{doc}:{i}", content, None, None, kind)


def test_bm25_order_and_limit(spark):
    rows = spark.createDataFrame([chunk("d", 1, "apple apple apple"), chunk("d", 2, "apple apple x"), chunk("d", 3, "apple x y"), chunk("d", 4, "pear")], CHUNK)
    q = spark.createDataFrame([(0, "apple"), (1, "!!")], "query_id int, text string")
    found = lexical.search(rows, q, 2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id) for r in found] == [(0, "d:1"), (0, "d:2")]


def test_filters_leave_statistics_alone(spark):
    rows = spark.createDataFrame([chunk("first", 0, "Straße OpenRouter"), chunk("second", 0, "open road", "text/markdown"), chunk("third", 0, "else", None)], CHUNK)
    q = spark.createDataFrame([(0, "  STRASSE open-router ")], "query_id int, text string")
    one = lexical.search(rows, q, 9, Filters(("first",)), analyzer=unicode_terms).collect()
    two = lexical.search(rows, q, 9, Filters(("first",), ("text/plain",)), analyzer=unicode_terms).collect()
    assert [r.chunk_id for r in one] == ["first:0"] and one[0].score == two[0].score
    assert lexical.search(rows, q, 9, Filters((), ("application/json",)), analyzer=unicode_terms).count() == 0


def test_chunks_scored_where_they_are_read_equal_joins(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 60}"
    text = lambda: rng.choice([None, "", "!!", " ".join(word() for _ in range(rng.randint(1, 30))), "w1 w1 w2"])
    rows = [(f"d{k % 40}", k, f"c{k}", text(), rng.choice([None, "w1 w1", word()]), rng.choice([None, "/w2", ""]), rng.choice([None, "text/plain", "Text/Markdown"])) for k in range(400)]
    odd = [(None, None, "c-null", "w1 w3", None, None, None), ("d1", 1, "c-copy", "w1 w1 w2", "w1", None, "text/plain")]
    q = spark.createDataFrame([(0, "w1"), (1, "w1 W2 w3 w1 none"), (None, "w2 w5"), (2, "!!"), (3, None), (4, "none"), (1, "w9 w1")], "query_id int, text string")
    found = lambda df: sorted(((r.query_id is None, r.query_id or 0, r["rank"], r.document_id or "", r.chunk_index or 0, r.chunk_id or "", r.score) for r in df.collect()))
    settings = Bm25Settings(k1=1.5, b=0.6, content_boost=0.5, title_boost=3.0, section_boost=0.0)
    twice = [("d3", 3, "c3", "w1 w2", None, None, "text/plain"), ("d0", 9, None, "w1", None, None, None)]
    kinds = (None, Filters((), ("text/markdown",)), Filters(("d1", "d2"), ("text/plain",)))
    for chunks, filters, s, limit in ((rows + odd, kinds[0], None, 9), (rows + odd, kinds[1], settings, 3), (rows + odd, kinds[2], settings, 1), (rows + odd + twice, kinds[0], None, 500), ([], kinds[0], None, 5)):
        frame = spark.createDataFrame(chunks, CHUNK).repartition(3)
        each = []
        for named, together in ((1 << 14, 1 << 20), (1 << 14, 40), (0, 1)):
            monkeypatch.setattr(lexical, "NAMED_TERMS", named)
            monkeypatch.setattr(lexical, "SCORES_TOGETHER", together)
            each.append(found(lexical.search(frame, q, limit, filters, s)))
        assert each[0] == each[1] and [x[:-1] for x in each[0]] == [x[:-1] for x in each[2]]
        assert [x[-1] for x in each[0]] == pytest.approx([x[-1] for x in each[2]], abs=2e-9)
        assert bool(each[0]) == bool(chunks)


def test_common_words_take_no_index_and_no_shuffle_of_postings(spark, data, monkeypatch):
    monkeypatch.setattr(tables, "_indexes", {})
    found = retrieval.bm25_fielded_boosts(spark, data)
    assert found.count() and not tables._indexes
    q = tables.asked(spark, data)
    plan = lexical.scored(tables.chunks(spark, data), q, limit=32)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan


def test_blank_chunk_stops_the_build(spark):
    with pytest.raises(IndexBuildError) as e:
        lexical.check_rows(spark.createDataFrame([chunk("d", 0, " \n\t ")], CHUNK))
    assert e.value.field == "content"


def test_dense_filters_before_the_limit(spark):
    docs = [("A", 0, "a", "text/plain", [0.0]), ("A", 1, "b", "text/markdown", [0.25]), ("B", 0, "c", "application/json", [0.5]), ("C", 0, "d", "text/plain", [0.75])]
    rows = spark.createDataFrame(docs, "document_id string, chunk_index int, chunk_id string, content_type string, embedding array<float>")
    q = spark.createDataFrame([(0, [0.0])], "query_id int, vector array<float>")
    ids = lambda f, n=4: [r.chunk_id for r in dense.search(rows, q, n, f).orderBy("rank").collect()]
    assert ids(None) == ["a", "b", "c", "d"] and ids(Filters(("A", "B"))) == ["a", "b", "c"]
    assert ids(Filters((), ("text/markdown", "text/plain")), 2) == ["a", "b"] and ids(Filters(("C",), ("application/json",))) == []
    assert dense.search(rows, q, 1).first().score == 1.0
    with pytest.raises(InvalidSettings):
        dense.query_vector([float("nan")])


def lists(spark, *rows):
    return spark.createDataFrame([(0, v, s, d, 0, c, x) for v, s, d, c, x in rows], LIST)


BOTH = (("vector", "doc-s", "shared", 0.9), ("vector", "doc-z", "vector-only", 0.8), ("bm25", "doc-s", "shared", 7.0), ("bm25", "doc-a", "bm25-only", 6.0))


def both(spark):
    return lists(spark, *((0, *r) for r in BOTH))


def test_weighted_fusion(spark):
    out = fusion.fuse(both(spark)).orderBy("rank").collect()
    assert [(r.chunk_id, r.fused_score) for r in out] == [("shared", 1 / 61 + 1 / 61), ("bm25-only", 1 / 62), ("vector-only", 1 / 62)]
    assert (out[0].vector_rank, out[0].bm25_rank, len(out[0].provenance)) == (1, 1, 2)


def test_a_source_of_no_weight_is_left_out(spark):
    out = fusion.fuse(both(spark), RetrievalSettings(vector_weight=0.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["shared", "bm25-only"] and all(r.vector_rank is None and r.vector_score is None for r in out)
    out = fusion.fuse(both(spark), RetrievalSettings(bm25_weight=0.0)).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["shared", "vector-only"]


def test_repeats_and_odd_scores(spark):
    twice = lists(spark, (0, "bm25", "d", "c", 2.0), (0, "bm25", "d", "c", 1.0))
    assert [r.fused_score for r in fusion.fuse(twice).collect()] == [1 / 61]
    for odd in (float("nan"), float("inf")):
        with pytest.raises(NonFiniteScore):
            fusion.check_scores(lists(spark, (0, "bm25", "d", "c", odd)))


def test_across_variants(spark):
    rows = lists(spark, (0, "vector", "d", "a", 0.9), (0, "bm25", "d", "a", 0.4), (1, "bm25", "d", "a", 0.8))
    out = fusion.fuse_variants(fusion.fuse(rows)).collect()
    assert [(r.fused_score, r.bm25_score, r.vector_score) for r in out] == [(2 / 61, 0.8, 0.9)]
    assert [(p.variant, p.score) for p in out[0].provenance if p.source == "bm25"] == [(0, 0.4), (1, 0.8)]
    rows = lists(spark, (0, "vector", "d", "a", 1.0), (0, "bm25", "d", "a", 2.0), (0, "bm25", "d", "b", 1.0), (1, "bm25", "d", "b", 2.0), (1, "bm25", "d", "a", 1.0))
    out = fusion.fuse_variants(fusion.fuse(rows)).orderBy("rank").collect()
    assert [(r.chunk_id, r.fused_score) for r in out] == [("a", 1 / 61 + 1 / 62), ("b", 1 / 62 + 1 / 61)]


def test_one_variant_passes_unchanged(spark):
    fused = fusion.fuse(both(spark), RetrievalSettings(candidate_limit=20, final_limit=1))
    across = fusion.fuse_variants(fused)
    assert sorted((r.chunk_id, r.fused_score) for r in across.collect()) == sorted((r.chunk_id, r.fused_score) for r in fused.collect())
    with pytest.raises(InvalidSettings):
        fusion.check_variants(lists(spark, *((v, "bm25", "d", "c", 1.0) for v in range(9))))


def test_nearest_rows_by_products_are_those_by_differences():
    import numpy as np
    import pyarrow as pa

    random = np.random.default_rng(1)
    odd = [[float("inf"), 0.0, 0.0], [float("nan"), 0.0, 0.0], [1e160, 0.0, 0.0]]
    for offset, extra in ((0.0, []), (1e7, []), (0.0, odd)):
        rows = [*(offset + random.integers(-3, 4, (500, 3)) / 8).tolist(), *extra]
        asked = offset + random.integers(-3, 4, (150, 3)) / 8
        batch = pa.RecordBatch.from_pydict({"id": list(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float64()))})
        got = [x for b in dense._pairs(asked, list(range(150)), pa.int64(), 4)([batch]) for x in zip(*[b.column(c).to_pylist() for c in ("query_id", "id", "distance")], strict=True)]
        for q in range(150):
            d = np.square(np.array(rows) - asked[q]).sum(1)
            last = np.partition(d, 3)[3] + 1e-9
            near = [k for k, x in enumerate(d) if not x > last]
            assert [k for o, k, _ in got if o == q] == near
            np.testing.assert_array_equal([x for o, _, x in got if o == q], d[near])


def test_queries_meet_a_batch_in_few_products(monkeypatch):
    import numpy as np
    import pyarrow as pa

    seen = []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda a, k, **x: (seen.append(np.size(a)), real(a, k, **x))[1])
    vectors = np.random.default_rng(2).normal(size=(2000, 8))
    batch = pa.RecordBatch.from_pydict({"id": list(range(2000)), "embedding": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    list(dense._pairs(vectors[:128], list(range(128)), pa.int64(), 5)([batch]))
    assert sum(n == 2000 for n in seen) == 0  # no query is held against all rows one by one


def test_terms_are_counted_where_a_chunk_is_read(spark):
    def post(rows):
        tok = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_id string, content array<string>, title array<string>, section_path array<string>")
        out = lexical.postings(tok)
        return out._jdf.queryExecution().toString(), sorted((r.chunk_id, r.field, r.length, r.term, r.tf) for r in out.collect())

    one, other = ("a", 0, "a:0", ["y", "x", "y", "y"], ["x"], []), ("b", 0, "b:0", ["z"], [], ["z", "z"])
    expected = [("a:0", "content", 4, "x", 1), ("a:0", "content", 4, "y", 3), ("a:0", "title", 1, "x", 1), ("b:0", "content", 1, "z", 1), ("b:0", "section_path", 2, "z", 2)]
    plan, got = post([one, other])
    assert got == expected and "Exchange" not in plan and "Aggregate" not in plan
    # rows of one key: fields of the same length are one, others stay apart
    twice = ("a", 0, "a:0", ["x", "x", "q", "y"], [], ["s"])
    longer = ("a", 0, "a:0", ["x"], [], [])
    _, got = post([one, other, twice, longer])
    assert got == sorted([("a:0", "content", 1, "x", 1), ("a:0", "content", 4, "q", 1), ("a:0", "content", 4, "x", 3), ("a:0", "content", 4, "y", 4), ("a:0", "section_path", 1, "s", 1), *expected[2:]])
