"""What clients see, and answers of a chat model."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.errors import InvalidSettings
from corvane.operators import dense, events
from corvane.plans import plugins, workflow
from corvane.settings import RetrievalSettings, Settings


def test_frames(spark):
    rows = spark.createDataFrame(
        [("node_started", "N", "a<b> & \"c\"\u2028", None, None), ("node_failed", "N", None, 3, None), ("checkpoint", None, None, None, None), ("final_answer", None, None, None, None), ("workflow_completed", None, None, None, '{"answer":"x"}'), ("stream_error", None, None, None, None), ("other", None, None, None, None)],
        "event string, node_name string, inputs_summary string, error_kind int, response string",
    )
    found = {r.event: r.frame for r in events.frames(rows).collect()}
    assert set(found) == {"node_started", "node_failed", "final_answer", "workflow_completed", "stream_error"}
    assert found["node_started"] == 'event: node_started\ndata: {"inputs_summary":"a\\u003cb\\u003e \\u0026 \\"c\\"\\u2028","node_name":"N","sequence_ordinal":0}\n\n'
    data = {k: json.loads(v.split("data: ", 1)[1]) for k, v in found.items()}
    assert data["node_failed"] == {"error_kind": 3, "error_message": "", "node_name": "N", "retryable": False} and data["stream_error"] == {"code": "", "message": ""}
    assert data["final_answer"]["citations"] == [] and data["final_answer"]["notices"] == [] and data["final_answer"]["snapshot"] is None
    assert data["workflow_completed"]["final_response"] == {"answer": "x"} and "notices" not in data["workflow_completed"] and len(data["workflow_completed"]["metadata"]) == 10
    assert all(list(d) == sorted(d) for k, d in data.items() if k != "final_answer")


def test_response_keeps_the_variants_inside(spark):
    body = json.dumps({"answer": "a", "answer_basis": 2, "citations": ["[1]"], "notices": [{"code": "GRAPH_ABLATION", "message": "m", "severity": 1}, {"code": "?", "message": "m", "severity": 2}], "snapshot": {"rrf_k": 60, "variant_count": 2, "variant_identities": ["x"], "vector_weight": 1.0}})
    found = json.loads(spark.createDataFrame([(body,)], "s string").select(events.response(F.col("s"))).first()[0])
    assert list(found) == ["answer", "citations", "session_id", "answer_basis", "structured_citations", "notices", "snapshot"]
    assert [n["typed_code"] for n in found["notices"]] == [18, 0] and "variant_count" not in found["snapshot"] and found["snapshot"]["rrf_k"] == 60 and len(found["snapshot"]) == 9


def test_a_chat_model_answers_and_a_bad_reply_fails_alone(spark):
    def complete(body):
        request = json.loads(body)
        prompt = request["messages"][0]["content"]
        assert request["response_format"]["json_schema"]["strict"] and request["max_tokens"] > 0
        answer = {"answer": "So it is [1].", "cited_evidence_ids": ["[1]"], "answer_basis": "retrieval", "notices": [], "warnings": []}
        if "pears" in prompt.split("Question:")[1].split("\n")[0]:
            answer["extra"] = 1
        return json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": json.dumps(answer)}}], "usage": {"prompt_tokens": 5, "completion_tokens": 5, "total_tokens": 10}})

    schema = "document_id string, chunk_index int, chunk_id string, content string, title string, section_path string, content_type string"
    chunks = spark.createDataFrame([("d", 0, "d:0", "apples and pears grow", None, None, "text/plain")], schema)
    q = spark.createDataFrame([(0, "apples"), (1, "pears")], "query_id int, question string")
    settings = Settings(retrieval=RetrievalSettings(vector_weight=0.0))
    found = workflow.ask(workflow.Corpus(chunks), q, settings, generator=plugins.ChatGenerator(complete, "some-model"), graph_context=False)
    assert [(r.query_id, r.answer) for r in found.answers.collect()] == [(0, "So it is [1].")]
    assert [(r.query_id, r.node, r.kind, r.message) for r in found.failures.collect()] == [(1, "GenerateAnswer", "malformed_reply", "content")]
    with pytest.raises(InvalidSettings):
        plugins.ChatGenerator(complete, "m", temperature=3.0)


def test_dense_search_in_parts_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(f"d{k}", 0, f"d{k}:0", "x", rng.random(4).tolist()) for k in range(50)], "document_id string, chunk_index int, chunk_id string, content_type string, embedding array<double>")
    asked = spark.createDataFrame([(k, rng.random(4).tolist() if k % 9 else None) for k in range(40)] + [(99, [1.0])], "query_id int, vector array<double>")
    whole = sorted(map(tuple, dense.search(rows, asked, 3).collect()))
    found = dense.distances(rows, asked, ("chunk_id",))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2  # one for each length of vectors
    monkeypatch.setattr(dense, "TOGETHER", 200)
    assert sorted(map(tuple, dense.search(rows, asked, 3).collect())) == whole and len(whole) == 35 * 3
