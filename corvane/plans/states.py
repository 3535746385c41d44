"""Queries of ingestion state, checkpoints, intents and inspection."""

from __future__ import annotations

import contextlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunking, privacy, state
from corvane.operators import events as client
from corvane.plans.tables import CHUNKS_SQL, chunks, table
from corvane.plans import workflow
from corvane.sources.catalog import Store
from corvane.sources.schemas import SCHEMAS
from corvane.sources.shared import shared_dir, spread
from corvane.streaming import jobs

NOW = "2024-01-10 00:00:00"


def status_updates(spark: SparkSession, d: str) -> DataFrame:
    return jobs.as_updates(table(spark, d, "events"))


def status_state_machine(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_status(status_updates(spark, d)).select("document_id", "status", "seq")


def status_merge_replay(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches, the second of which repeats a part of the first."""
    rows = status_updates(spark, d)
    first = state.latest_status(rows.where("seq % 3 <> 2"))
    return state.merge_status(first, rows.where("seq % 3 <> 0")).select("document_id", "status", "seq")


def status_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = status_updates(spark, d)
    known = state.latest_status(rows.where("document_id % 3 = 0"))
    ids = rows.select("document_id").distinct()
    return state.read_status(ids, known, rows.where("document_id % 3 = 1"))


def staged(spark: SparkSession, d: str) -> DataFrame:
    """Orders as staged versions of a customer's document."""
    rows = table(spark, d, "orders")
    return rows.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("generation"), F.concat(F.col("o_orderstatus"), F.lit(".txt")).alias("filename"), F.round("o_totalprice", 2).alias("size"))


def staged_latest_generation(spark: SparkSession, d: str) -> DataFrame:
    return state.latest_staged(staged(spark, d)).select("document_id", "generation", "filename", "size", "_n").withColumnRenamed("_n", "n_rows")


def staged_successor_generation(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    return state.next_generation(new, staged(spark, d)).select("document_id", "filename", "generation")


def staged_row_validation(spark: SparkSession, d: str) -> DataFrame:
    """Ids of version-4 form, and chunk settings within range."""
    rows = table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("h"), (F.col("o_orderkey") % 900 - 20).alias("size"), (F.col("o_orderkey") % 70 - 3).alias("overlap"))
    four = F.when(F.col("o_orderkey") % 3 == 0, "4").otherwise("1")
    id_ = F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.concat(four, F.substring("h", 14, 3)), F.concat(F.lit("a"), F.substring("h", 18, 3)), F.substring("h", 21, 12))
    ok = tx.is_uuid4(F.upper(id_)) & F.col("size").between(1, 1048576) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("size"))
    return rows.select("o_orderkey", id_.alias("document_id"), ok.alias("valid"))


def replace_document(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after the documents of one language came anew with larger windows and one came empty."""
    old = chunks(spark, d).select("document_id", "chunk_id", "chunk_index", F.length("content").alias("n_chars"))
    docs = table(spark, d, "documents").where("lang = 'en'").withColumn("document_id", F.col("doc_id").cast("string"))
    new = chunking.fixed_windows(docs, "text", 900, 100, ["document_id"])
    new = new.select("document_id", F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "chunk_index", F.length("content").alias("n_chars"))
    empty = spark.createDataFrame([("5",)], "document_id string")
    return state.replaced(old, new, also=empty)


def upload_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    named = (F.col("l_linenumber") == 1) | ((F.col("l_orderkey") % 50 == 2) & (F.col("l_linenumber") == 3))
    frames = rows.select(
        F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("seq"), F.when(named, F.concat(F.when((F.col("l_orderkey") % 50 == 2) & (F.col("l_orderkey") % 4 == 0) & (F.col("l_linenumber") == 3), "x").otherwise("d"), "l_orderkey")).alias("document_id"),
        F.when(F.col("l_orderkey") % 50 == 3, F.lit("")).otherwise(F.concat(F.lit("part "), "p", F.lit(";"))).cast("binary").alias("data"),
    )
    out = state.frames_joined(frames, 40)
    return out.select("upload_id", "document_id", F.md5("raw_content").alias("content_md5"), "error")


def upload_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into frames of 1,000 bytes and joined again."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("upload_id"), F.concat(F.lit("d"), "doc_id").alias("document_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw_content"))
    out = state.frames_joined(state.frames_of(spread(docs), 1000), 10_000_000)
    return out.select("upload_id", "document_id", F.md5("raw_content").alias("content_md5"), "error")


def upload_validation(spark: SparkSession, d: str) -> DataFrame:
    """Uploads made of orders, some of which break a rule."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 13 == 0, " \t").when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".JSON"))).otherwise(F.concat(k.cast("string"), F.lit(".md"))).alias("filename"), ((k % 17) * 1_000_000).alias("n_bytes"),
        F.when(k % 11 == 0, "guess").when(k % 2 == 0, "fixed_size").otherwise("structure_aware").alias("chunk_strategy"), (k % 900 - 20).alias("chunk_size"), (k % 70 - 3).alias("chunk_overlap"),
    )
    return state.validated_uploads(rows).select("o_orderkey", "chunk_strategy", "error")


def traced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("trace_id", F.col("user_id"))


def event_ordinals_terminal_once(spark: SparkSession, d: str) -> DataFrame:
    out = state.event_stream(traced(spark, d), terminal=F.col("event_type") == "purchase")
    return out.select("trace_id", "event_id", "event_type", "ordinal")


def checkpoint_ordering(spark: SparkSession, d: str) -> DataFrame:
    rows = state.event_stream(traced(spark, d)).withColumn("node", F.col("event_type"))
    snapshot = F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return state.checkpoints(rows.withColumn("context_snapshot", snapshot))


def sse_json_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = state.event_stream(traced(spark, d).where("event_type <> 'click'"))
    payload = F.to_json(F.struct("trace_id", "ordinal", F.get_json_object("props", "$.k").cast("int").alias("k"), F.struct("event_type").alias("data")))
    return rows.select("event_id", state.sse_frame(F.col("event_type"), payload).alias("frame"))


def sse_workflow_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of all kinds of events, errors of the stream among them; checkpoints are no client's."""
    k, props = F.col("event_id"), F.concat(F.lit("<b> & "), "props")
    kind = F.when(k % 41 == 0, "workflow_completed").when(k % 50 == 0, "stream_error")
    for name, event in (("view", "node_started"), ("click", "node_completed"), ("error", "node_failed"), ("signup", "answer_chunk")):
        kind = kind.when(F.col("event_type") == name, event)
    rows = table(spark, d, "events").select(
        "event_id", kind.otherwise("checkpoint").alias("event"), F.col("event_type").alias("node_name"), k.alias("sequence_ordinal"), props.alias("inputs_summary"), (k * 2).alias("duration_ms"), (k % 7).alias("error_kind"),
        props.alias("error_message"), (k % 2 == 0).alias("retryable"), props.alias("chunk_text"), F.lit("LOST").alias("code"), props.alias("message"), F.lit(True).alias("success"), k.alias("total_duration_ms"), (k % 5).alias("vector_count"),
    )
    return client.frames(rows).select("event_id", "event", "frame")


def intents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as intents: due by their date, retried by their priority."""
    rows = table(spark, d, "orders")
    return rows.select(F.col("o_orderkey").alias("document_id"), F.lit("failed").alias("desired_status"), F.col("o_orderpriority").alias("reason_class"), F.substring("o_orderpriority", 1, 1).cast("int").alias("retry_count"), F.col("o_orderdate").alias("next_attempt_at"))


def reconcile_due_topn(spark: SparkSession, d: str) -> DataFrame:
    return state.due_intents(intents(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"), 10).select("document_id", "retry_count")


def reconcile_backoff(spark: SparkSession, d: str) -> DataFrame:
    rows = intents(spark, d).withColumn("retry_count", F.col("retry_count") * 3 - 3)
    return rows.select("document_id", "retry_count", tx.backoff_seconds(F.col("retry_count")).alias("seconds"))


def reconcile_lease(spark: SparkSession, d: str) -> DataFrame:
    rows, now = intents(spark, d), F.lit("1998-01-01").cast("timestamp_ntz")
    out = state.leased(rows, state.due_intents(rows, now, 10), now)
    return out.groupBy("next_attempt_at").agg(F.count("*").alias("n"))


def reconcile_create(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"))
    ask = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit("engine_lost").alias("reason_class"), F.lit("1999-01-01").cast("timestamp_ntz").alias("now"))
    return state.created_intents(current, intents(spark, d), ask).select("document_id", "reason_class", "retry_count")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).where("chunk_id <> '3:1'").select("document_id", "chunk_id", "chunk_index")
    n = F.col("document_id").cast("int")
    vector = F.when(n % 17 == 0, F.array(F.lit(1.0), F.lit(float("nan")))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    return rows.withColumns({"embedding": vector, "embedding_model": F.when((n % 13 == 0) & (F.col("chunk_index") == 0), "b").otherwise("a"), "ingested_at": F.lit(42)})


def store_inspection_facts(spark: SparkSession, d: str) -> DataFrame:
    edges = chunking.chunk_edges(chunks(spark, d).select("document_id", "chunk_id", "chunk_index", F.lit(None).cast("string").alias("section_path")))
    return state.store_facts(nodes(spark, d), edges)


def count_consistency(spark: SparkSession, d: str) -> DataFrame:
    counted = lambda df: df.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    own = counted(chunks(spark, d))
    off = own.withColumn("chunk_count", F.when(F.col("document_id").endswith("7"), F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    return state.disagreeing([("gateway", own), ("metadata", off), ("store", counted(nodes(spark, d)))])


def store_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table of a store after nations were staged twice and ingested, with an upload that failed before it took effect."""
    store = Store.initialise(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=2)
    docs = table(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("document_id"), F.concat("n_name", F.lit(".txt")).alias("filename"), F.concat("n_name", F.lit(" "), "n_name").cast("binary").alias("raw_content"),
        F.lit("fixed_size").alias("chunk_strategy"), F.lit(10).alias("chunk_size"), F.lit(0).alias("chunk_overlap"),
    )
    for _ in range(2):
        store.stage(docs)
    top = store.table("staged_documents").agg(F.max("generation").alias("n")).select(F.lit("generation").alias("name"), F.col("n").cast("long").alias("n"))
    top = spark.createDataFrame(top.collect(), top.schema)
    workflow.replay(store)

    def fail(name: str) -> None:
        raise OSError(name)

    store.before_write = fail
    with contextlib.suppress(OSError):
        store.stage(docs)
    counts = [store.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in SCHEMAS]
    return reduce(DataFrame.union, counts, top)


def header_sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.safe_header(F.col("text"), 64).alias("header"))


def lossy_decode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.lossy_text(F.col("text").cast("binary"))).alias("text_md5"))


def legacy_migration(spark: SparkSession, d: str) -> DataFrame:
    """Staged rows of the schema before generations, which all become the first."""
    legacy = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("filename"))
    return legacy.withColumn("generation", F.lit(1).cast("long"))


def count_rows_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table of a store that meet a condition, as the inspector counts them."""
    rows = chunks(spark, d)
    return rows.where("document_id = '7' and content_type = 'application/json'").agg(F.count("*").alias("n")).union(rows.where("chunk_index > 3").agg(F.count("*")))


def saturating_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts that stop at the largest integer, and budgets that stop at 0."""
    wide = F.col("o_orderkey") * 700_000
    return table(spark, d, "orders").select("o_orderkey", tx.saturating_int(wide).alias("n_tokens"), tx.saturating_int(F.lit(8192) - F.col("o_orderkey")).alias("left_over"))


def response_json_projection(spark: SparkSession, d: str) -> DataFrame:
    """What a client gets of an answer: its fields without those of the variants."""
    turn = table(spark, d, "conversations").where("role = 'assistant'")
    snapshot = F.struct(F.col("conv_id").alias("document_count"), F.lit(1).alias("variant_count"), F.col("role").alias("model"))
    answer = turn.select("conv_id", "turn", F.struct(F.substring("text", 1, 30).alias("answer"), F.array(F.lit("[1]")).alias("citations"), snapshot.dropFields("variant_count").alias("snapshot")).alias("r"))
    return answer.select("conv_id", "turn", F.to_json("r").alias("response"))


def strict_json_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a strict reader of the events' properties would refuse."""
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"z": 1, "a": 2, '), F.substring("props", 2, 99))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.array_join(tx.unknown_keys(props, ["k"]), ",").alias("unknown"))


def privacy_fields(spark: SparkSession, d: str) -> DataFrame:
    """Sensitive fields in properties, nested in lists and objects, by class."""
    props = F.col("props")
    nested = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a": [1, {"userCredentials": '), props, F.lit('}], "raw-content": "x", "ok": {"apiKey": null, "k": [[{"X-Header": 1}]]}}')))
    nested = nested.when(F.col("event_id") % 3 == 1, F.concat(F.lit('[{"bearer": {"secrets": '), props, F.lit("}}]"))).otherwise(props)
    found = privacy.sensitive(spread(table(spark, d, "events")).select("event_id", nested.alias("body")), "event_id", "body")
    return found.groupBy("event_id", "category").agg(F.count("*").alias("n"))


def stream_status_available_now(spark: SparkSession, d: str) -> DataFrame:
    """The state machine run as a stream over the events until all are read."""
    return jobs.run_status(spark, d).select("document_id", "status", "seq")


def stream_event_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user numbered up to the first purchase by state in a stream."""
    return jobs.run_numbers(spark, d).select("trace_id", "event_id", "event_type", F.col("ordinal").cast("int").alias("ordinal"))


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums in windows of an hour, as a stream with a watermark."""
    return jobs.run_windows(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        status_state_machine, status_merge_replay, status_lookup, staged_latest_generation, staged_successor_generation, staged_row_validation, replace_document, upload_frames,
        event_ordinals_terminal_once, checkpoint_ordering, sse_json_projection, sse_workflow_frames, reconcile_due_topn, reconcile_backoff, reconcile_lease, reconcile_create,
        store_inspection_facts, upload_round_trip, upload_validation, count_consistency, store_ingest_counts, header_sanitize, lossy_decode, legacy_migration, count_rows_predicate, saturating_token_counts, response_json_projection, strict_json_keys, privacy_fields, stream_status_available_now, stream_event_ordinals, stream_event_windows,
    )
}

UPDATES_SQL = """updates AS (
  SELECT event_id % 700 AS document_id, ts AS moment, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status FROM events)"""


def _latest(rows: str = "updates") -> str:
    return f"""(SELECT document_id,
  coalesce(arg_min(status, (moment, seq)) FILTER (status IN ('completed', 'failed')), arg_max(status, (moment, seq))) AS status,
  coalesce(arg_min(seq, (moment, seq)) FILTER (status IN ('completed', 'failed')), arg_max(seq, (moment, seq))) AS seq FROM {rows} GROUP BY document_id)"""


STAGED_SQL = "staged AS (SELECT o_custkey AS document_id, o_orderkey AS generation, o_orderstatus || '.txt' AS filename, round(o_totalprice, 2) AS size FROM orders)"
INTENTS_SQL = "intents AS (SELECT o_orderkey AS document_id, o_orderpriority AS reason_class, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS retry_count, o_orderdate AS next_attempt_at FROM orders)"
NODES_SQL = f"{CHUNKS_SQL}, nodes AS (SELECT *, CAST(document_id AS INTEGER) AS n FROM chunks WHERE chunk_id <> '3:1')"

ORDINALS_SQL = """WITH x AS (SELECT user_id AS trace_id, event_id, event_type, row_number() OVER w AS ordinal,
  coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT trace_id, event_id, event_type, CAST(ordinal AS INTEGER) AS ordinal FROM x WHERE ended = 0"""

SQL = {
    "status_state_machine": f"WITH {UPDATES_SQL} FROM {_latest()}",
    "status_merge_replay": f"WITH {UPDATES_SQL} FROM {_latest()}",
    "status_lookup": f"""WITH {UPDATES_SQL} SELECT document_id, CASE document_id % 3 WHEN 0 THEN status ELSE 'queued' END AS status FROM {_latest()} WHERE document_id % 3 < 2""",
    "stream_status_available_now": f"WITH {UPDATES_SQL} FROM {_latest()}",
    "staged_latest_generation": f"WITH {STAGED_SQL}, t AS (SELECT *, max(generation) OVER (PARTITION BY document_id) AS top FROM staged) SELECT document_id, generation, filename, size, count(*) OVER (PARTITION BY document_id) AS n_rows FROM t WHERE generation = top",
    "staged_successor_generation": f"WITH {STAGED_SQL}, m AS (SELECT document_id, max(generation) AS g FROM staged GROUP BY 1) SELECT c_custkey AS document_id, c_name AS filename, coalesce(g, 0) + 1 AS generation FROM customer LEFT JOIN m ON document_id = c_custkey",
    "staged_row_validation": """WITH x AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h, o_orderkey % 900 - 20 AS size, o_orderkey % 70 - 3 AS overlap FROM orders)
SELECT o_orderkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || CASE o_orderkey % 3 WHEN 0 THEN '4' ELSE '1' END || substring(h, 14, 3) || '-a' || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS document_id,
       o_orderkey % 3 = 0 AND size >= 1 AND overlap >= 0 AND overlap < size AS valid FROM x""",
    "replace_document": f"""WITH {CHUNKS_SQL},
n AS (SELECT document_id, CAST(k AS INTEGER) AS chunk_index, substring(text, 1 + k * 800, 900) AS content
      FROM (SELECT *, unnest(range(0, CASE WHEN n <= 900 THEN 1 ELSE CAST(ceil((n - 900) / 800.0) AS BIGINT) + 1 END)) AS k FROM docs WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')))
SELECT document_id, chunk_id, chunk_index, CAST(length(content) AS INTEGER) AS n_chars FROM chunks WHERE document_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'en') AND document_id <> '5'
UNION ALL SELECT document_id, document_id || ':' || chunk_index, chunk_index, CAST(length(content) AS INTEGER) FROM n""",
    "upload_frames": """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS seq, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
f AS (SELECT k, seq, CASE WHEN seq = 1 OR (k % 50 = 2 AND seq = 3) THEN CASE WHEN k % 50 = 2 AND k % 4 = 0 AND seq = 3 THEN 'x' ELSE 'd' END || k END AS document_id, CASE WHEN k % 50 = 3 THEN '' ELSE 'part ' || p || ';' END AS data FROM r),
u AS (SELECT k AS upload_id, first(document_id ORDER BY seq) AS document_id, count(document_id) AS named, count(DISTINCT document_id) AS ids, sum(strlen(data)) AS n, string_agg(data, '' ORDER BY seq) AS content FROM f GROUP BY k)
SELECT upload_id, document_id, CASE WHEN error IS NULL THEN md5(content) END AS content_md5, error FROM (
  SELECT *, CASE WHEN document_id IS NULL THEN 'metadata_missing' WHEN ids > 1 THEN 'document_changed' WHEN named > 1 THEN 'metadata_repeated' WHEN n > 40 THEN 'too_large' WHEN n = 0 THEN 'empty' END AS error FROM u)""",
    "upload_round_trip": """SELECT doc_id AS upload_id, 'd' || doc_id AS document_id, CASE WHEN coalesce(text, '') <> '' THEN md5(text) END AS content_md5, CASE WHEN coalesce(text, '') = '' THEN 'empty' END AS error FROM documents""",
    "upload_validation": """WITH x AS (SELECT o_orderkey, o_orderkey % 13 = 0 AS blank, o_orderkey % 3 = 0 AND NOT blank AS is_json, o_orderkey % 17 * 1000000 AS n, CASE WHEN o_orderkey % 11 = 0 THEN 'guess' WHEN o_orderkey % 2 = 0 THEN 'fixed_size' ELSE 'structure_aware' END AS s,
  o_orderkey % 900 - 20 AS size, o_orderkey % 70 - 3 AS overlap FROM orders)
SELECT o_orderkey, CASE WHEN is_json OR s = 'fixed_size' THEN 'fixed_size' ELSE 'structure_aware' END AS chunk_strategy,
       CASE WHEN blank THEN 'filename' WHEN n = 0 THEN 'empty' WHEN n > 10485760 THEN 'too_large' WHEN s = 'guess' THEN 'chunk_strategy' WHEN size < 1 THEN 'chunk_size' WHEN overlap < 0 OR overlap >= size THEN 'chunk_overlap' END AS error FROM x""",
    "event_ordinals_terminal_once": ORDINALS_SQL,
    "stream_event_ordinals": ORDINALS_SQL,
    "checkpoint_ordering": """SELECT user_id AS trace_id, CAST(row_number AS INTEGER) AS sequence_ordinal, 'post_' || event_type AS node_name, props AS context_snapshot
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number FROM events) WHERE event_id % 9 <> 0""",
    "sse_json_projection": """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'click')
SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"trace_id":' || user_id || ',"ordinal":' || n || ',"k":' || json_extract_string(props, '$.k') || ',"data":{"event_type":"' || event_type || '"}}' || chr(10) || chr(10) AS frame FROM x""",
    "sse_workflow_frames": """WITH x AS (SELECT event_id AS k, event_type AS t, replace(replace(replace('<b> & ' || replace(props, '"', chr(92) || '"'), '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS p,
  CASE WHEN event_id % 41 = 0 THEN 'workflow_completed' WHEN event_id % 50 = 0 THEN 'stream_error' WHEN event_type = 'view' THEN 'node_started' WHEN event_type = 'click' THEN 'node_completed' WHEN event_type = 'error' THEN 'node_failed'
       WHEN event_type = 'signup' THEN 'answer_chunk' END AS event FROM events)
SELECT k AS event_id, event, 'event: ' || event || chr(10) || 'data: ' || CASE event WHEN 'node_started' THEN '{"inputs_summary":"' || p || '","node_name":"view","sequence_ordinal":' || k || '}' WHEN 'node_completed' THEN '{"duration_ms":' || 2 * k || ',"node_name":"click","outputs_summary":""}'
  WHEN 'node_failed' THEN '{"error_kind":' || k % 7 || ',"error_message":"' || p || '","node_name":"error","retryable":' || (k % 2 = 0) || '}' WHEN 'answer_chunk' THEN '{"chunk_text":"' || p || '","is_final":false}' WHEN 'stream_error' THEN '{"code":"LOST","message":"' || p || '"}'
  ELSE '{"error_kind":' || k % 7 || ',"error_message":"' || p || '","notices":[],"metadata":{"bm25_count":0,"completed_at_ms":0,"completion_tokens":0,"degraded_mode":false,"graph_edge_count":0,"graph_node_count":0,"prompt_tokens":0,"reformulation_used":false,"started_at_ms":0,"vector_count":' || k % 5 || '},"success":true,"total_duration_ms":' || k || '}' END || chr(10) || chr(10) AS frame
FROM x WHERE event IS NOT NULL""",
    "reconcile_due_topn": f"WITH {INTENTS_SQL} SELECT document_id, retry_count FROM intents WHERE next_attempt_at <= TIMESTAMP '1998-01-01' ORDER BY next_attempt_at, document_id LIMIT 10",
    "reconcile_backoff": f"WITH {INTENTS_SQL} SELECT document_id, retry_count * 3 - 3 AS retry_count, CAST(least(pow(2, least(retry_count * 3 - 3, 10)), 60) AS INTEGER) AS seconds FROM intents",
    "reconcile_lease": f"""WITH {INTENTS_SQL}, due AS (SELECT document_id FROM intents WHERE next_attempt_at <= TIMESTAMP '1998-01-01' ORDER BY next_attempt_at, document_id LIMIT 10)
SELECT CASE WHEN document_id IN (FROM due) THEN TIMESTAMP '1998-01-01 00:00:30' ELSE next_attempt_at END AS next_attempt_at, count(*) AS n FROM intents GROUP BY 1""",
    "reconcile_create": f"""WITH {INTENTS_SQL}, new AS (SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'O')
SELECT document_id, reason_class, retry_count FROM intents WHERE document_id NOT IN (FROM new) UNION ALL SELECT document_id, 'engine_lost', 0 FROM new""",
    "store_inspection_facts": f"""WITH {NODES_SQL},
n AS (SELECT document_id, any_value(n) AS k, count(*) AS c, min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 AS contiguous FROM nodes GROUP BY 1),
e AS (SELECT document_id, count(*) AS c FROM chunks WHERE chunk_index > 0 GROUP BY 1),
s AS (SELECT document_id, count(*) FILTER (chunk_id = '3:1' AND chunk_index > 0) + count(*) FILTER (chunk_id = '3:2') AS c FROM chunks GROUP BY 1),
f AS (SELECT n.document_id, n.c AS chunk_count, coalesce(e.c, 0) AS edge_count, contiguous, n.k % 17 <> 0 AS finite, coalesce(s.c, 0) AS stale_ends, NOT (n.k % 13 = 0 AND n.c > 1) AS one FROM n LEFT JOIN e USING (document_id) LEFT JOIN s USING (document_id))
SELECT document_id, chunk_count, edge_count, contiguous, finite, stale_ends, contiguous AND finite AND stale_ends = 0 AND one AS sound FROM f""",
    "count_consistency": f"""WITH {NODES_SQL}, a AS (SELECT document_id, count(*) AS gateway FROM chunks GROUP BY 1), b AS (SELECT document_id, count(*) AS store FROM nodes GROUP BY 1)
SELECT document_id, gateway, gateway + CASE WHEN document_id LIKE '%7' THEN 1 ELSE 0 END AS metadata, store FROM a LEFT JOIN b USING (document_id) WHERE document_id LIKE '%7' OR store IS DISTINCT FROM gateway""",
    "store_ingest_counts": """WITH n AS (SELECT ceil((2 * length(n_name) + 1) / 10.0) AS k FROM nation)
SELECT 'generation' AS name, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'documents', count(*) FROM n UNION ALL SELECT 'nodes', CAST(sum(k) AS BIGINT) FROM n UNION ALL SELECT 'edges', CAST(sum(k - 1) AS BIGINT) FROM n
UNION ALL SELECT unnest(['entities', 'entity_edges', 'staged_documents', 'communities']), 0""",
    "header_sanitize": "SELECT doc_id, substring(regexp_replace(text, '[^!-~]', '', 'g'), 1, 64) AS header FROM documents",
    "lossy_decode": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "legacy_migration": "SELECT o_orderkey AS document_id, o_orderstatus AS filename, CAST(1 AS BIGINT) AS generation FROM orders",
    "count_rows_predicate": f"WITH {CHUNKS_SQL} SELECT count(*) AS n FROM chunks WHERE document_id = '7' AND content_type = 'application/json' UNION ALL SELECT count(*) FROM chunks WHERE chunk_index > 3",
    "saturating_token_counts": "SELECT o_orderkey, CAST(greatest(0, least(o_orderkey * 700000, 2147483647)) AS INTEGER) AS n_tokens, CAST(greatest(0, 8192 - o_orderkey) AS INTEGER) AS left_over FROM orders",
    "response_json_projection": """SELECT conv_id, turn, '{"answer":' || to_json(substring(text, 1, 30)) || ',"citations":["[1]"],"snapshot":{"document_count":' || conv_id || ',"model":"assistant"}}' AS response
FROM conversations WHERE role = 'assistant'""",
    "strict_json_keys": """SELECT event_id, array_to_string(list_sort(list_filter(json_keys(CASE WHEN event_id % 3 = 0 THEN '{"z": 1, "a": 2, ' || substring(props, 2, 99) ELSE props END), lambda x: x <> 'k')), ',') AS unknown FROM events""",
    "privacy_fields": f"""WITH x AS (SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN '{{"a": [1, {{"userCredentials": ' || props || '}}], "raw-content": "x", "ok": {{"apiKey": null, "k": [[{{"X-Header": 1}}]]}}}}'
  WHEN 1 THEN '[{{"bearer": {{"secrets": ' || props || '}}}}]' ELSE props END AS JSON) AS body FROM events),
k AS (SELECT event_id, regexp_replace(lower(regexp_replace(t.key, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]', '_', 'g') AS w FROM x, json_tree(x.body) t WHERE t.key IS NOT NULL AND NOT regexp_matches(t.fullkey, '\\]$')),
c AS (SELECT event_id, CASE {" ".join("WHEN " + " OR ".join(f"contains(w, '{k}') OR contains(replace(w, '_', ''), '{k.replace('_', '')}')" for k in keys) + f" THEN '{name}'" for name, keys in privacy.CATEGORIES)} END AS category FROM k)
SELECT event_id, category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL""",
    "stream_event_windows": """SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2000-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
}
