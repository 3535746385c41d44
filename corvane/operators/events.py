"""What a client sees of a run: its response, and its events as server-sent frames.

Texts are JSON as a browser may embed it: the signs that open markup are escaped. Payloads of events have their keys in alphabetical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.snapshot import number
from corvane.operators.state import sse_frame

# The fields of a response, of its citations and of its retrieval snapshot, in order; what else a run knows stays inside.
CITATION = "chunk_id string, document_id string, title string, section_path string, excerpt string, is_truncated boolean, score double, rank int, content_type string"
SNAPSHOT = (
    "index_generation string, embedding_model string, vector_weight double, bm25_weight double, rrf_k int, candidate_limit int, final_limit int, "
    "active_filter struct<document_ids: array<string>, content_types: array<string>>, result_hash string"
)
RESPONSE = f"answer string, citations array<string>, session_id string, answer_basis int, structured_citations array<struct<{CITATION}>>, notices array<struct<code string, message string, severity int>>, snapshot struct<{SNAPSHOT}>"
#: The counts that a finished run tells, in order, and those that are no number.
METADATA = ("bm25_count", "completed_at_ms", "completion_tokens", "degraded_mode", "graph_edge_count", "graph_node_count", "prompt_tokens", "reformulation_used", "started_at_ms", "vector_count")
FLAGS = ("degraded_mode", "reformulation_used")
STREAM_ERROR = "stream_error"
# The numbers of notice codes.
CODE_NUMBERS = {
    "UNSPECIFIED": 0, "NO_EVIDENCE": 1, "GRAPH_TIMEOUT": 2, "GRAPH_DEGRADED": 3, "MODEL_NOTICE": 4, "MODEL_WARNING": 5, "GRAPH_UNAVAILABLE": 10, "RETRIEVAL_DEGRADED_DENSE": 11, "CITATION_REPAIRED": 12,
    "CITATION_DROPPED": 13, "MODEL_ONLY": 14, "BASIS_RECONCILED": 15, "RETRIEVAL_DEGRADED_BM25": 16, "GRAPH_ABLATION": 18, "INDEX_REBUILD_FAILED": 20, "INDEX_STALE": 21, "INDEX_GENERATION_MISMATCH": 22,
}


def embeddable(json: Column) -> Column:
    """JSON text without the characters that could end a script or a line."""
    out = json
    for sign in "<>&  ":
        out = F.replace(out, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return out


def _json(value: Column) -> Column:
    return embeddable(F.to_json(value, {"ignoreNullFields": "false"}))


def typed_code(code: Column) -> Column:
    """The number of a notice's code; 0 for one that has none."""
    return number(code, CODE_NUMBERS)


def response(snapshot: Column) -> Column:
    """The response out of a run's last snapshot (JSON): lists are never null, notices have the number of their code, and the variants stay inside."""
    known = F.from_json(snapshot, RESPONSE)
    lists = {c: F.coalesce(known[c], F.array()) for c in ("citations", "structured_citations")}
    notices = F.transform(F.coalesce(known["notices"], F.array().cast("array<struct<code string, message string, severity int>>")), lambda n: F.struct(n["code"], n["message"], n["severity"], typed_code(n["code"]).alias("typed_code")))
    names = ("answer", "citations", "session_id", "answer_basis", "structured_citations", "notices", "snapshot")
    return _json(F.struct(*[(notices if c == "notices" else lists.get(c, known[c])).alias(c) for c in names]))


def payload(event: Column, rows: DataFrame) -> Column:
    """The payload of one event out of the columns that it has; those that ``rows`` lacks are empty, 0 or false. Null for events that no client sees."""

    def of(name: str, kind: str) -> Column:
        empty = F.lit({"string": "", "boolean": False}.get(kind, 0)).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), empty) if name in rows.columns else empty).alias(name)

    response_json = F.col("response") if "response" in rows.columns else F.lit(None).cast("string")
    failed = F.struct(of("error_kind", "int"), of("error_message", "string"), of("node_name", "string"), of("retryable", "boolean"))
    completed = F.struct(of("duration_ms", "long"), of("node_name", "string"), of("outputs_summary", "string"))
    started = F.struct(of("inputs_summary", "string"), of("node_name", "string"), of("sequence_ordinal", "long"))
    metadata = _json(F.struct(*[of(c, "boolean" if c in FLAGS else "long") for c in METADATA]))
    result = F.when(response_json.isNotNull(), F.concat(F.lit('"final_response":'), response_json)).otherwise(F.lit('"notices":[]'))
    whole = F.concat(
        F.lit('{"error_kind":'), of("error_kind", "int").cast("string"), F.lit(',"error_message":'), _text(of("error_message", "string")), F.lit(","), result, F.lit(',"metadata":'), metadata,
        F.lit(',"success":'), of("success", "boolean").cast("string"), F.lit(',"total_duration_ms":'), of("total_duration_ms", "long").cast("string"), F.lit("}"),
    )
    return (
        F.when(event == "node_started", _json(started)).when(event == "node_completed", _json(completed)).when(event == "node_failed", _json(failed))
        .when(event == "answer_chunk", _json(F.struct(of("chunk_text", "string"), of("is_final", "boolean")))).when(event == "final_answer", F.coalesce(response_json, response(F.lit("{}"))))
        .when(event == "workflow_completed", whole).when(event == STREAM_ERROR, _json(F.struct(of("code", "string"), of("message", "string"))))
    )


def _text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(_json(F.struct(value.alias("x"))), r'^\{"x":|\}$', "")


def frames(rows: DataFrame) -> DataFrame:
    """``rows`` (``event`` and the columns of its kind) with ``frame``; checkpoints and unknown events are left out, as they are no client's."""
    out = rows.withColumn("_payload", payload(F.col("event"), rows)).where("_payload is not null")
    return out.withColumn("frame", sse_frame(F.col("event"), F.col("_payload"))).drop("_payload")
