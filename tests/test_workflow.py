"""What the workflow does when a part of it fails, and what it records."""

import json
import threading

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from corvane.errors import QueueFull
from corvane.functions.analyze import vector_digest
from corvane.operators import prompt, replies, snapshot
from corvane.plans import plugins, workflow
from corvane.settings import GraphSettings, GroundingLimits, RetrievalSettings, Settings, Timeouts
from corvane.sources.catalog import Store
from corvane.streaming import jobs

CHUNK = "document_id string, chunk_index int, chunk_id string, content string, title string, section_path string, content_type string"
EMBEDDER = plugins.HashEmbedder(16)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("d", k, f"d:{k}", t, "Title", None, "text/plain") for k, t in enumerate(("apples grow on trees. Yes.", "pears grow on trees, too. Yes.", "stones lie around. No."))]
    chunks = spark.createDataFrame(rows, CHUNK).withColumn("embedding", EMBEDDER.embed(F.col("content")))
    vertices = spark.createDataFrame([("a", "apples", "fruit"), ("p", "pears", "fruit"), ("t", "trees", "plant")], "entity_id string, name string, entity_type string")
    edges = spark.createDataFrame([("e1", "a", "t", "grow_on", 1.0), ("e2", "p", "t", "grow_on", 0.5)], "edge_id string, source_node_id string, target_node_id string, relation_type string, weight float")
    return workflow.Corpus(chunks, vertices.withColumn("name_vector", EMBEDDER.embed(F.col("name"))), edges)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, question string")


SETTINGS = Settings(graph=GraphSettings(seed_match_min_score=0.3), retrieval=RetrievalSettings(final_limit=2))


def codes(found):
    return sorted((r.query_id, r.code) for r in found.notices.collect())


def test_an_answer_with_facts_events_and_checkpoints(spark, corpus):
    sink = plugins.MemorySink()
    found = workflow.ask(corpus, asked(spark, "apples"), SETTINGS, embedder=EMBEDDER, sink=sink, session_id="s")
    assert found.answers.first().answer_basis == "retrieval" and codes(found) == [] and found.failures.isEmpty()
    assert found.citations.first().title == "Title" and found.citations.first().content_type == "text/plain"
    events = [(r.event, r.node) for r in found.events.orderBy("ordinal").collect()]
    assert events == [(e, s) for s in workflow.STEPS for e in ("node_started", "node_completed")] + [(e, "") for e in ("answer_chunk", "final_answer", "workflow_completed")]
    kept = [sink.rows["0", k] for k in range(1, 6)]
    assert [name for name, _ in kept] == [f"post_{s}" for s in workflow.STEPS]
    bodies = [json.loads(body) for _, body in kept]
    assert all(tuple(b) == snapshot.KEYS for b in bodies)
    assert [bool(b["assembled_prompt"]) for b in bodies] == [False, False, False, True, True] and [bool(b["answer"]) for b in bodies] == [False] * 4 + [True]
    assert bodies[0]["query_embedding"] is None and bodies[0]["variants"] == ["apples"] and bodies[0]["session_id"] == "s"
    vector = found.checkpoints.sparkSession.createDataFrame([("apples",)], "t string").select(EMBEDDER.embed(F.col("t")).alias("v")).first().v
    assert bodies[1]["query_embedding"] == {"dimension": 16, "hash": vector_digest(vector)}
    fact = bodies[1]["graph_facts"][0]["fact"]
    assert bodies[1]["graph_context"] == "apples -- grow_on -- trees" and (fact["entity_a_name"], fact["relation_type"], fact["entity_b_name"], fact["edge_summary"]) == ("apples", "grow_on", "trees", None)
    assert [b["answer_basis"] for b in bodies] == [0, 0, 0, 0, 1] and [b["snapshot"] is None for b in bodies] == [True, True, False, False, False]
    controls = bodies[2]["snapshot"]
    assert tuple(controls) == ("index_generation", "embedding_model", "vector_weight", "bm25_weight", "rrf_k", "candidate_limit", "final_limit", "active_filter", "result_hash", "variant_count", "variant_identities")
    assert controls["rrf_k"] == 60 and controls["variant_identities"] == ["apples"] and controls["variant_count"] == 1 and len(controls["result_hash"]) == 64 and controls["embedding_model"] == EMBEDDER.model
    assert tuple(bodies[4]["evidence_blocks"][0]) == snapshot.EVIDENCE
    assert tuple(bodies[4]["structured_citations"][0]) == snapshot.CITED
    assert bodies[2]["bm25_results"] == ["d:0"] and len(bodies[2]["final_candidates"]) == 2 and len(bodies[2]["evidence_blocks"]) == 2
    assert bodies[4]["citations"] and bodies[4]["structured_citations"][0]["chunk_id"] == "d:0"


def test_the_assembled_prompt_has_the_fixed_parts(spark):
    block = "query_id int, rank int, chunk_id string, document_id string, chunk_index int, title string, section_path string, content_type string, content string, fused_score double"
    blocks = prompt.evidence(spark.createDataFrame([(0, 1, "d:0", "d", 0, "O'Neil", None, None, "text", 1.0)], block))
    facts = spark.createDataFrame([(0, "e", "A", "has", "B", 0.5)], "query_id int, edge_id string, entity_a string, relation_type string, entity_b string, score double")
    q = asked(spark, "Why?")
    text = prompt.assemble(q, blocks, facts).first().prompt
    assert "\n\nQuestion: Why?\n\nEvidence:\n<EVIDENCE id=" in text and "<TITLE>O&apos;Neil</TITLE>" in text
    assert "## Related Entities & Relationships\n<GRAPH_FACT entity_a=\"A\" relation=\"has\" entity_b=\"B\" score=\"0.5000\">\nA —has→ B\n</GRAPH_FACT>\n\n" in text
    assert "say so.\nWhen a 'Related Entities & Relationships' section is present" in text and prompt.HEADER_TOKENS == 7
    plain = prompt.assemble(q, blocks).first().prompt
    assert "Related Entities" not in plain and "## " not in plain


@pytest.mark.parametrize("part", ["dense", "words", "graph"])
def test_a_part_that_fails_gives_a_notice(spark, corpus, part):
    boom = lambda c: F.when(F.length(F.lit("x")) > 0, F.raise_error(F.lit("boom"))).otherwise(c)
    chunks, vertices, analyzer = corpus.chunks, corpus.vertices, None
    if part == "dense":
        chunks = chunks.withColumn("embedding", boom(F.col("embedding")))
    if part == "graph":
        vertices = vertices.withColumn("name_vector", boom(F.col("name_vector")))
    if part == "words":
        analyzer = lambda c: F.array(boom(c))
    found = workflow.ask(workflow.Corpus(chunks, vertices, corpus.edges), asked(spark, "apples", "pears"), SETTINGS, embedder=EMBEDDER, **({"analyzer": analyzer} if analyzer else {}))
    code = {"dense": "RETRIEVAL_DEGRADED_DENSE", "words": "RETRIEVAL_DEGRADED_BM25", "graph": "GRAPH_DEGRADED"}[part]
    assert codes(found) == [(0, code), (1, code)] and found.answers.count() == 2
    assert all(r.cited_evidence_ids for r in found.answers.collect())


def test_an_embedding_that_fails_ends_the_run(spark, corpus):
    def call(text):
        raise plugins.TransientError("down")

    with pytest.raises(Exception, match="down"):
        workflow.ask(corpus, asked(spark, "apples"), SETTINGS, embedder=plugins.CallingEmbedder(call, 16, "m", wait=0.0))


def test_one_question_fails_alone(spark, corpus):
    class Lying(plugins.FirstSentences):
        def answer(self, prompts):
            rows = super().answer(prompts)
            return rows.withColumn("cited_evidence_ids", F.when(F.col("query_id") == 1, F.array(F.lit("[9]"))).otherwise(F.col("cited_evidence_ids")))

    settings = Settings(graph=SETTINGS.graph, citation_repair=False)
    found = workflow.ask(corpus, asked(spark, "apples", "pears", "  "), settings, embedder=EMBEDDER, generator=Lying())
    assert {r.query_id: (r.node, r.kind) for r in found.failures.collect()} == {1: ("GenerateAnswer", "grounding"), 2: ("ReformulateQuery", "invalid_query")}
    assert [r.query_id for r in found.answers.collect()] == [0]
    last = {t: max((r.ordinal, r.event, r.node) for r in found.events.collect() if r.trace_id == t) for t in range(3)}
    assert last[1][1:] == ("node_failed", "GenerateAnswer") and last[2] == (2, "node_failed", "ReformulateQuery") and last[0][1] == "workflow_completed"
    tight = Settings(graph=SETTINGS.graph, grounding=GroundingLimits(evidence_tokens=200, output_tokens=60))
    found = workflow.ask(corpus, asked(spark, "apples"), tight, embedder=EMBEDDER)
    assert found.failures.first().kind == "no_evidence_fits" and found.answers.isEmpty()


def test_limits_of_the_graph_hold_for_each_question(spark, corpus):
    many = spark.range(600).select(F.concat(F.lit("m"), "id").alias("edge_id"), F.lit("a").alias("source_node_id"), F.concat(F.lit("x"), "id").alias("target_node_id"), F.lit("r").alias("relation_type"), F.lit(1.0).cast("float").alias("weight"))
    found = workflow.ask(workflow.Corpus(corpus.chunks, corpus.vertices, corpus.edges.unionByName(many)), asked(spark, "apples", "pears"), SETTINGS, embedder=EMBEDDER)
    assert codes(found) == [(0, "GRAPH_DEGRADED")] and found.answers.count() == 2
    off = workflow.ask(corpus, asked(spark, "apples"), SETTINGS, embedder=EMBEDDER, graph_context=False)
    assert codes(off) == [(0, "GRAPH_ABLATION")]
    far = workflow.ask(corpus, asked(spark, "apples"), Settings(graph=GraphSettings(seed_match_min_score=1.0)), embedder=plugins.HashEmbedder(16), filters=None)
    assert far.answers.count() == 1


def test_a_slow_graph_is_cancelled(spark, corpus):
    slow = F.udf(lambda v: __import__("time").sleep(20) or v, "array<float>")
    vertices = corpus.vertices.withColumn("name_vector", slow("name_vector"))
    short = Timeouts(reformulate=60_000, embedding=60_000, retrieve=60_000, graph_operation=1_500, graph=62_000, assemble=60_000)
    found = workflow.ask(workflow.Corpus(corpus.chunks, vertices, corpus.edges), asked(spark, "apples"), SETTINGS, embedder=EMBEDDER, timeouts=short)
    assert codes(found) == [(0, "GRAPH_TIMEOUT")] and found.answers.count() == 1


def test_model_only_answers_are_noted(spark, corpus):
    found = workflow.ask(workflow.Corpus(corpus.chunks.limit(0)), asked(spark, "apples"), Settings(allow_model_only=True), embedder=EMBEDDER)
    assert codes(found) == [(0, "GRAPH_UNAVAILABLE"), (0, "MODEL_ONLY"), (0, "NO_EVIDENCE")] and found.answers.first().answer_basis == "model_only"


def test_providers_are_asked_again_and_checked(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def flaky(text):
        seen = marks / text.strip()
        if not seen.exists():
            seen.write_text("")
            raise plugins.TransientError
        return [float(len(text))] * 3

    rows = spark.createDataFrame([("a",), ("bb",), ("ccc",)], "t string").coalesce(1)
    got = [r.v[0] for r in rows.select(plugins.CallingEmbedder(flaky, 3, "m", wait=0.0).embed(F.col("t")).alias("v")).collect()]
    assert got == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="one vector of 4"):
        rows.select(plugins.CallingEmbedder(lambda t: [1.0] * 3, 4, "m").embed(F.col("t"))).collect()

    def extract(text):
        if "bad" in text:
            raise ValueError("malformed")
        return {"entities": [{"name": text, "entity_type": "x"}], "relations": []}

    chunks = spark.createDataFrame([("d", "d:0", 0, "good"), ("d", "d:1", 1, "bad")], "document_id string, chunk_id string, chunk_index int, content string")
    assert [r.chunk_id for r in plugins.CallingExtractor(extract, wait=0.0).extract(chunks).collect()] == ["d:0"]


def test_replies(spark):
    answer = {"answer": "Yes [1].", "cited_evidence_ids": ["[1]"], "answer_basis": "retrieval", "notices": [], "warnings": []}
    body = lambda content, **more: json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": content if isinstance(content, str) else json.dumps(content)}}], **more})
    usage = lambda p, c, t: {"usage": {"prompt_tokens": p, "completion_tokens": c, "total_tokens": t}}
    cases = [
        (body(answer), None), (body(answer, **usage(10, 5, 15)), None), (body(answer, other=1), None), ("x", "wrapper"), (body(answer) + "}", "wrapper"), ('{"choices": []}', "choices"), ("{}", "choices"),
        (body(answer).replace("stop", "length"), "unfinished"), (body(answer).replace('"finish_reason": "stop", ', ""), "unfinished"), (body("no json"), "content"), (body(answer | {"more": 1}), "content"),
        (body({k: v for k, v in answer.items() if k != "warnings"}), "content"), (body(answer | {"answer": 5}), "content"), (body(answer | {"answer_basis": "guess"}), "content"), (body(answer | {"notices": [1]}), "content"),
        (body(answer, **usage(9000, 5, 9005)), "prompt_tokens"), (body(answer, **usage(10, 3000, 3010)), "completion_tokens"), (body(answer, **usage(10, 5, 14)), "total_tokens"), (body(answer | {"answer": "x" * 300_000}), "too_large"),
    ]
    rows = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(cases)], "i int, body string").select("i", replies.parsed(F.col("body")).alias("r")).orderBy("i").collect()
    assert [r.r.failure for r in rows] == [f for _, f in cases]
    assert rows[1].r.reply.cited_evidence_ids == ["[1]"] and rows[1].r.usage.total_tokens == 15 and rows[3].r.reply is None


def test_dispatcher_keeps_order_and_counts_what_it_drops():
    gate, written, tries = threading.Event(), [], []

    class Sink:
        def write(self, rows):
            gate.wait(10)
            tries.append(rows)
            if rows == 3:
                raise OSError
            written.append(rows)

    d = jobs.Dispatcher(Sink(), running=1, overflow=1, pending=3)
    got = [d.submit(k) for k in range(7)]
    assert got == ["admitted", "admitted", "pending", "pending", "pending", "dropped", "dropped"]
    gate.set()
    assert d.close(10) and written == [0, 1, 2, 4] and tries.count(3) == 3 and d.dropped == 3 and d.submit(9) == "dropped"


def test_reconciler_ticks(spark):
    rows = [(i, "failed", "lost", 0, "2024-01-01 00:00:00") for i in range(12)] + [(99, "failed", "lost", 0, "2030-01-01 00:00:00")]
    intents = spark.createDataFrame(rows, "document_id int, desired_status string, reason_class string, retry_count int, t string").withColumn("next_attempt_at", F.col("t").cast("timestamp_ntz")).drop("t")
    now = lambda: F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    out = jobs.reconcile(intents, now, lambda due: due.where("document_id % 2 = 0").select("document_id"), 1)
    got = {r.document_id: r.retry_count for r in out.collect()}
    assert got == {1: 1, 3: 1, 5: 1, 7: 1, 9: 1, 10: 0, 11: 0, 99: 0}
    out = jobs.reconcile(out, now, lambda due: due.select("document_id"), 2, wait=lambda: None)
    assert sorted(r.document_id for r in out.collect()) == [1, 3, 5, 7, 9, 99]

    def down(due):
        raise OSError

    assert jobs.reconcile(intents, now, down, 1).count() == 13
    tried = []
    assert jobs.compensate(lambda: tried.append(1), lambda: "failed" if len(tried) == 3 else None, wait=lambda k: None) == "failed" and len(tried) == 3
    assert jobs.compensate(lambda: 1 / 0, lambda: "completed", wait=lambda k: None) == "completed"
    assert jobs.compensate(lambda: None, lambda: "processing", attempts=2, wait=lambda k: None) is None


def test_ingestion_that_fails(spark, tmp_path):
    store = Store.initialise(spark, str(tmp_path / "s"), buckets=2)
    staged = spark.createDataFrame([("d", "d.txt", bytearray(b"Alice Smith met Bob Jones in the old town of Rome today."), "fixed_size", 100, 10)], "document_id string, filename string, raw_content binary, chunk_strategy string, chunk_size int, chunk_overlap int")

    class Failing:
        def extract(self, chunks):
            raise ValueError("no model")

    store.stage(staged, capacity=1)
    with pytest.raises(QueueFull):
        store.stage(staged.withColumn("document_id", F.lit("e")), capacity=1)
    out = workflow.replay(store, embedder=EMBEDDER, extractor=Failing()).first()
    assert (out.status, out.message) == ("completed", "graph: no model") and store.count("nodes") == 1 and store.count("staged_documents") == 0
    assert workflow.replay(store) is None

    def fail(name):
        if name in broken:
            raise OSError("disk")

    store.stage(staged)
    broken, store.before_write = {"nodes"}, fail
    assert workflow.replay(store, embedder=EMBEDDER).first().status == "failed" and store.count("staged_documents") == 0
    store.stage(staged)
    broken = {"nodes", "staged_documents"}
    assert workflow.replay(store, embedder=EMBEDDER).isEmpty() and store.count("staged_documents") == 1
    broken = set()
    assert workflow.replay(store, embedder=EMBEDDER).first().status == "completed" and store.count("staged_documents") == 0


def test_preflight_passes_once():
    calls = []

    def check():
        calls.append(1)
        if len(calls) == 1:
            raise OSError

    p = plugins.Preflight(check)
    with pytest.raises(OSError):
        p.ready()
    threads = [threading.Thread(target=p.ready) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 2


def test_jobs_end_when_nobody_waits(spark):
    slow = F.udf(lambda x: __import__("time").sleep(60) or x, "long")
    ended = []

    def read():
        try:
            spark.range(2).select(slow("id")).collect()
        except Exception as error:
            ended.append(error)

    with workflow.cancelled_when_left(spark):
        t = InheritableThread(target=read)
        t.start()
        t.join(3)
        assert t.is_alive()
    t.join(30)
    assert ended and not t.is_alive()
