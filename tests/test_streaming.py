import pytest
from pyspark.sql import functions as F

from corvane.errors import TimedOut
from corvane.functions.text import strict_json
from corvane.plans import plugins, workflow
from corvane.sources.catalog import Store
from corvane.streaming import jobs


def test_folder_is_ingested_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# One\n\nBody of one.\n")
    (folder / "b.json").write_text('{"a": 1}')
    store = Store.initialise(spark, str(tmp_path / "store"), buckets=2)
    jobs.ingest_folder(spark, str(folder), store, 10, 2)
    nodes = {(r.document_id, r.chunk_index): r.section_path for r in store.table("nodes").collect()}
    assert nodes[("a.md", 0)] == "/One" and ("b.json", 0) in nodes
    version = store.manifest["version"]
    jobs.ingest_folder(spark, str(folder), store, 10, 2)
    assert store.manifest["version"] == version
    (folder / "c.txt").write_text("more")
    jobs.ingest_folder(spark, str(folder), store, 10, 2)
    assert store.count("documents") == 3


def test_sessions(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00")], "user_id int, at string").select("user_id", F.col("at").cast("timestamp").alias("ts"))
    assert sorted(r.n for r in jobs.sessions(rows).collect()) == [1, 2]


def test_retries_only_what_may_pass():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise plugins.TransientError
        return "done"

    assert plugins.with_retries(flaky, 3, 1.0, waits.append) == "done" and waits == [1.0, 2.0]
    with pytest.raises(plugins.TransientError):
        calls.clear()
        plugins.with_retries(flaky, 2, 1.0, waits.append)
    with pytest.raises(KeyError):
        plugins.with_retries(lambda: {}["x"], 3, 1.0, waits.append)


def test_time_limit_cancels(spark):
    assert workflow.with_time_limit(spark, 60, lambda: spark.range(3).count()) == 3
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    with pytest.raises(TimedOut):
        workflow.with_time_limit(spark, 1.5, lambda: spark.range(2).select(slow("id")).collect())


def test_strict_json(spark):
    one = lambda text: spark.createDataFrame([(text,)], "t string").select(strict_json(F.col("t"), "a int, b string").alias("x")).first().x
    assert one('{"a": 1}').a == 1
    for bad in ('{"a": 1, "c": 2}', '{"a": 1} x', "[1]", '{"a": "x"}'):
        with pytest.raises(Exception):  # noqa: B017
            one(bad)


def test_workflow_without_evidence(spark):
    chunks = spark.createDataFrame([("d", 0, "d:0", "some words here", None, None, "text/plain")], "document_id string, chunk_index int, chunk_id string, content string, title string, section_path string, content_type string")
    embedder = plugins.HashEmbedder(8)
    corpus = workflow.Corpus(chunks.withColumn("embedding", embedder.embed(F.col("content"))))
    q = spark.createDataFrame([(0, "words")], "query_id int, question string")
    found = workflow.ask(corpus, q, embedder=embedder)
    assert found.answers.first().cited_evidence_ids == ["[1]"] and found.citations.first().chunk_id == "d:0"
    none = workflow.ask(workflow.Corpus(corpus.chunks.limit(0)), q, embedder=embedder)
    row = none.answers.first()
    assert (row.answer, row.answer_basis, row.notices) == ("", "model_only", [workflow.NO_GRAPH, workflow.NO_EVIDENCE])
