"""The kept index against the search that cuts all chunks into terms anew."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions.analyze import unicode_terms
from corvane.operators import lexical
from corvane.settings import Bm25Settings, Filters
from corvane.sources import index as kept
from corvane.sources.catalog import Store
from corvane.sources.index import InvertedIndex

CHUNK = "document_id string, chunk_index int, chunk_id string, content string, title string, section_path string, content_type string"
KINDS = ("text/plain", "text/markdown", None)


def made(rng, doc, n=3):
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    return [(f"d{doc}", k, f"d{doc}:{k}", " ".join(word() for _ in range(rng.randint(1, 40))), rng.choice([None, "w1 Title", word()]), rng.choice([None, "/w2"]), rng.choice(KINDS)) for k in range(n)]


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.document_id, r.chunk_index, round(r.score, 8)) for r in df.collect())


QUERIES = [(0, "w1"), (1, "w3 w7 w250"), (2, "w1 w2 w3 w4 w5 w6 title"), (3, "nothing here"), (4, "!!"), (5, "W9 w9 w12"), (6, "w399 w388 w2")]


@pytest.fixture
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, text string")


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(kept, "RANGE_BITS", 2)
    monkeypatch.setattr(kept, "FIRST_RANGES", 1)
    monkeypatch.setattr(kept, "FEW_PLACES", 0)
    monkeypatch.setattr(kept, "CHUNKS_A_BUCKET", 50)


def test_index_equals_a_plain_search_after_changes(spark, tmp_path, asked, small_ranges):
    rng = random.Random(4)
    now = {k: made(rng, k) for k in range(120)}
    frame = lambda docs: spark.createDataFrame([c for d in docs for c in now[d]], CHUNK)
    index = InvertedIndex.build(spark, str(tmp_path / "i"), frame(now))
    first, before = index, rows_of(index.search(asked, 7))
    for step in range(2):
        some = rng.sample(sorted(now), 3 + 40 * step)
        old = frame(some)
        for d in some:
            now[d] = made(rng, d, rng.randint(0, 5))
        new = [d for d in some if now[d]]
        index = index.changed(frame(new) if new else old.limit(0), old)
    every = frame(now)
    assert rows_of(index.search(asked, 7)) == rows_of(lexical.search(every, asked, 7))
    kept.FEW_PLACES = 1 << 17  # all ranges at once, which gives the same
    assert rows_of(index.search(asked, 7)) == rows_of(lexical.search(every, asked, 7))
    kept.FEW_PLACES = 0
    odd, filters = Bm25Settings(k1=1.7, b=0.2, content_boost=0.4, title_boost=3.0, section_boost=0.0), Filters(("d1", "d5", "d9", "d77"), ("text/plain",))
    assert rows_of(index.search(asked, 3, filters, odd)) == rows_of(lexical.search(every, asked, 3, filters, odd))
    tok = lexical.tokens(every)
    plain = {r.term: r.df for r in lexical.document_frequency(lexical.postings(tok)).collect()}
    assert {r.term: r.df for r in index.frequencies().collect()} == plain
    n, averages = index.statistics()
    facts = lexical.statistics(tok).first()
    assert n == facts.n and all(abs(averages[f] - facts[f"avg_{f}"]) < 1e-9 for f in lexical.FIELDS)
    assert rows_of(first.search(asked, 7)) == before  # an index that was changed stays as it was
    again = InvertedIndex(spark, str(tmp_path / "i"), json.loads(json.dumps(index.entry)))
    assert rows_of(again.search(asked, 7)) == rows_of(index.search(asked, 7))
    assert len(index.segments) < 4


@pytest.mark.parametrize("ranges", (0, 1 << 19))
def test_totals_and_merges_leave_out_dead_chunks_without_a_row_for_each_posting(spark, tmp_path, monkeypatch, ranges):
    """Ranges of 128 places on both sides of 64, with and without dead ones; the last two segments are merged."""
    monkeypatch.setattr(kept, "FEW_RANGES", ranges)
    rng = random.Random(12)
    now = {k: made(rng, k) for k in range(150)}
    frame = lambda docs: spark.createDataFrame([c for d in docs for c in now[d]], CHUNK).coalesce(1)
    index = InvertedIndex.build(spark, str(tmp_path / "i"), frame(now))
    for some in (range(40, 60), range(50, 75)):
        old = frame(some)
        for d in some:
            now[d] = made(rng, d)
        index = index.changed(frame(some), old)
    assert [s["covers"] for s in index.segments] == [[1], [2, 3]]
    plain = {}
    for chunk in (c for d in now for c in now[d]):
        words = [re.findall(r"\w+", (chunk[k] or "").lower()) for k in (3, 4, 5)]
        for term in {t for x in words for t in x}:
            one = plain.setdefault(term, [0, 0, 0, 0])
            plain[term] = [a + b for a, b in zip(one, (1, *[x.count(term) for x in words]), strict=True)]
    totals = index.totals()
    assert {r["term"]: list(r)[1:] for r in totals.collect()} == plain
    own = {(r["term"], r["segment"], r["place"]): (r["tf_content"], r["length_content"]) for r in index.postings().where("segment > 1").collect()}
    merged = index._read("blocks", index.segments[1:]).collect()
    assert sum(b["n"] for b in merged) == len(own) and all(b["n"] == len(b["places"]) for b in merged)
    for b in merged:
        tf = [own[b["term"], b["segment"], (b["range"] << 7) + p] for p in b["places"]]
        most = max(x for x, _ in tf)
        assert b["most_content"] == most and b["least_content"] == (min(n for x, n in tf if x) if most else None)
        assert (b["tf_contents"] is None) == (most == 0)
    analysed = totals._jdf.queryExecution().analyzed().toString()
    assert "Generate" not in analysed


def test_blocks_below_the_last_place_are_left_unread(spark, tmp_path, small_ranges):
    """A few chunks are full of the rare term; the ranges of the others can't reach them."""
    rows = [(f"d{k}", 0, f"d{k}:0", "rare " * 30 if k % 100 == 7 else "common " * 20 + "rare" * (k % 3 == 0), None, None, "text/plain") for k in range(800)]
    every = spark.createDataFrame(rows, CHUNK)
    index = InvertedIndex.build(spark, str(tmp_path / "i"), every.repartition(2))
    asked = spark.createDataFrame([(0, "rare"), (1, "rare common")], "query_id int, text string")
    assert rows_of(index.search(asked, 4)) == rows_of(lexical.search(every, asked, 4))
    for r in index.skipped(asked, 4).collect():
        assert r.skipped > 0.5 * r.blocks


def test_a_search_opens_the_folders_of_its_terms_alone(spark, tmp_path, asked, small_ranges):
    rng = random.Random(6)
    rows = [c for k in range(200) for c in made(rng, k)]
    index = InvertedIndex.build(spark, str(tmp_path / "i"), spark.createDataFrame(rows, CHUNK))
    one = asked.where("query_id = 0")
    weighted, hashes, names = index._asked(one)
    files = index._blocks(hashes, names).inputFiles()
    buckets = {f.split("_bucket=")[1].split("/")[0] for f in files}
    assert len(index.segments[0]["blocks"]) > 4 and len(buckets) == 1 and names == ["w1"]
    plan = index._blocks(hashes, names)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in index._schema("blocks").fieldNames() and re.search(r"PushedFilters: \[[^\]]*term", plan)
    header = index.ranges(weighted, index._blocks(hashes, names), Bm25Settings())._jdf.queryExecution().executedPlan().toString()
    assert "entries" not in header


def test_other_analyzer_and_empty_index(spark, tmp_path, asked):
    none = spark.createDataFrame([], CHUNK)
    assert InvertedIndex.build(spark, str(tmp_path / "e"), none).search(asked, 3).collect() == []
    rows = spark.createDataFrame([("a", 0, "a:0", "Straße OpenRouter", None, None, None), ("b", 0, "b:0", "open road", None, None, "x")], CHUNK)
    index = InvertedIndex.build(spark, str(tmp_path / "u"), rows, unicode_terms)
    q = spark.createDataFrame([(0, "STRASSE open-router")], "query_id int, text string")
    assert rows_of(index.search(q, 9)) == rows_of(lexical.search(rows, q, 9, analyzer=unicode_terms))
    emptied = index.changed(none, rows)
    assert emptied.search(q, 9).collect() == [] and emptied.statistics()[0] == 0


def test_frequent_terms_lie_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "CHUNKS_A_PART", 100)
    rows = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("same").alias("content"), *[F.lit(None).cast("string").alias(c) for c in ("title", "section_path", "content_type")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = InvertedIndex.build(spark, str(tmp_path / "i"), rows.repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = f"{index.segments[0]['folder']}/blocks"
    assert len(spark.read.parquet(folder).inputFiles()) > 1
    assert [r["n"] for r in spark.read.parquet(folder).select("n").collect()] and spark.read.parquet(folder).agg(F.max("n"), F.sum("n")).first()[:] == (128, 2000)


def test_store_keeps_its_index_in_step(spark, tmp_path, asked):
    store = Store.initialise(spark, str(tmp_path / "s"), buckets=2)
    store.enable_index()
    rng = random.Random(9)

    def replace(ids):
        chunks = spark.createDataFrame([c for k in ids for c in made(rng, k)], CHUNK).withColumns({"char_start": F.lit(0), "char_end": F.lit(1), "token_estimate": F.lit(1)})
        docs = chunks.select("document_id", F.lit(b"x").alias("raw_content")).distinct()
        store.replace_documents(docs, chunks, spark.createDataFrame([], store.table("edges").schema))

    replace(range(30))
    replace(range(10, 20))
    nodes = store.table("nodes")
    assert rows_of(store.index().search(asked, 6)) == rows_of(lexical.search(nodes, asked, 6))
    opened = Store.open(spark, str(tmp_path / "s"))
    assert rows_of(opened.index().search(asked, 6)) == rows_of(lexical.search(nodes, asked, 6))
    version = store.manifest["version"]

    def fail(name):
        raise OSError(name)

    store.before_write = fail
    with pytest.raises(OSError):
        replace([1])
    assert store.manifest["version"] == version and rows_of(store.index().search(asked, 6)) == rows_of(lexical.search(nodes, asked, 6))


def test_blocks_of_a_folder_are_shuffled_as_one_row_and_come_back_whole(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    rng, fields = random.Random(8), ("content", "title", "section_path")
    schema = InvertedIndex(spark, "unused")._schema("blocks")
    words = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    rows = [{"segment": 1, "place": p, "content": words(20), "title": words(p % 3), "section_path": []} for p in range(3000)]
    tokens = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("segment", pa.int32()), ("place", pa.int64()), *[(f, pa.list_(pa.string())) for f in fields]]))
    made = kept._blocks_of(fields, 7, to_arrow_schema(schema))
    packed = kept._packed(schema, fields)
    out = list(kept._packing(made, fields, 4, to_arrow_schema(packed))(iter([tokens])))
    blocks = [b for batch in made(iter([tokens])) for b in batch.to_pylist()]
    assert 0 < sum(b.num_rows for b in out) < len(blocks) / 50 and max(b.num_rows for b in out) <= 4
    frame = spark.createDataFrame([tuple(r.values()) for b in out for r in b.to_pylist()], packed)
    back = [r.asDict() for r in kept._unpacked(frame, schema, fields).drop("_bucket").collect()]
    by = lambda b: (b["term"], b["range"])
    assert sorted(back, key=by) == sorted(blocks, key=by)
    at = {(b["term"], (b["range"] << 7) + p): n for b in blocks for p, n in zip(b["places"], b["tf_contents"] or [], strict=False) if n}
    assert at == {(w, r["place"]): r["content"].count(w) for r in rows for w in r["content"]}


def test_each_task_writes_as_many_folders(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('t', id) AS term", "id AS df")
    folders = InvertedIndex(spark, str(tmp_path))._write_by_term(rows, "terms", str(tmp_path), 32, F.lit(0), 1, ["term"], 32 * kept.CHUNKS_A_TASK)
    assert folders == list(range(32))
    files = [f.name for f in (tmp_path / "terms").rglob("part-*.parquet")]
    assert len(files) == 32 and len({f.split("-")[1] for f in files}) == 32  # no task has two
