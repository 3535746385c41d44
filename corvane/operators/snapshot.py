"""Snapshots of a question's context after each step, as JSON with the same keys each time."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.analyze import vector_digest

# The keys of a snapshot, in order, by the step that fills them.
KEYS = (
    "session_id", "trace_id", "original_query", "filter", "variants", "query_embedding", "graph_context", "graph_facts", "vector_results", "bm25_results",
    "final_candidates", "evidence_blocks", "assembled_prompt", "answer", "citations", "answer_basis", "structured_citations", "notices", "snapshot",
)
FILLED_BY = (
    ("session_id", "trace_id", "original_query", "filter", "variants"),
    ("query_embedding", "graph_context", "graph_facts"),
    ("vector_results", "bm25_results", "final_candidates", "evidence_blocks", "snapshot"),
    ("assembled_prompt",),
    ("answer", "citations", "answer_basis", "structured_citations", "notices"),
)
# What a snapshot shows of evidence and of citations, and the numbers of an answer's basis and a notice's severity.
EVIDENCE = ("id", "chunk_id", "document_id", "chunk_index", "title", "section_path", "content_type", "provenance", "text", "score", "rank", "suspicious")
CITED = ("chunk_id", "document_id", "title", "section_path", "excerpt", "is_truncated", "score", "rank", "content_type")
BASIS_NUMBERS = {"retrieval": 1, "mixed": 2, "model_only": 3}
SEVERITY_NUMBERS = {"info": 1, "warning": 2, "error": 3}
DIGEST = T.StructType([T.StructField("dimension", T.IntegerType()), T.StructField("hash", T.StringType())])


def digest(vector: Column) -> Column:
    """What a snapshot keeps of an embedding: its dimension and a hash; null for a null vector."""

    @F.arrow_udf(DIGEST)
    def found(vectors: pa.Array) -> pa.Array:
        rows = [None if v is None else {"dimension": len(v), "hash": vector_digest(v)} for v in vectors.to_pylist()]
        return pa.array(rows, pa.struct([("dimension", pa.int32()), ("hash", pa.string())]))

    return found(vector)


def _empty(kind: T.DataType) -> Column:
    value = F.array() if isinstance(kind, T.ArrayType) else F.lit("") if isinstance(kind, T.StringType) else F.lit(0) if isinstance(kind, T.IntegerType) else F.lit(None)
    return value.cast(kind)


def number(name: Column, numbers: dict[str, int]) -> Column:
    """The number of a name; 0 for one that has none."""
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in numbers.items()], F.lit(0))


def side_by_side(frames: list[DataFrame], key: str) -> DataFrame:
    """The first frame's rows with the columns of all others, each of which has a row a key at most, by one union and grouping in place of many joins."""
    columns = {f.name: f.dataType for df in frames for f in df.schema.fields if f.name != key}
    wide = [df.select(key, F.lit(k == 0).alias("_first"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]) for k, df in enumerate(frames)]
    rows = reduce(DataFrame.unionByName, wide).groupBy(key).agg(F.bool_or("_first").alias("_first"), *[F.first(c, ignorenulls=True).alias(c) for c in columns])
    return rows.where("_first").drop("_first")


def snapshots(contexts: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """``trace_id, sequence_ordinal, node_name, context_snapshot`` after each step, from one row of all ``KEYS`` a question.

    A key that a later step fills is empty before: an empty list or text, 0, else null. Every key stands in every snapshot.
    """
    rows, kinds = None, {f.name: f.dataType for f in contexts.schema.fields}
    for k, step in enumerate(steps):
        known = {key for keys in FILLED_BY[: k + 1] for key in keys}
        values = [F.coalesce(F.col(key), _empty(kinds[key])) if key in known else _empty(kinds[key]) for key in KEYS]
        body = F.to_json(F.struct(*[v.alias(key) for v, key in zip(values, KEYS, strict=True)]), {"ignoreNullFields": "false"})
        own = contexts.select("trace_id", F.lit(k + 1).alias("sequence_ordinal"), F.lit(f"post_{step}").alias("node_name"), body.alias("context_snapshot"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def step_events(questions: DataFrame, steps: tuple[str, ...], failed: DataFrame) -> DataFrame:
    """``trace_id, ordinal, event, node`` of each question's run, in order from 1; a failure (``query_id, node``) ends it.

    A run without failure ends with its answer and its completion.
    """
    # fixed values: the names of events
    named = [(e, s) for s in steps for e in ("node_started", "node_completed")] + [("answer_chunk", ""), ("final_answer", ""), ("workflow_completed", "")]
    order = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(e).alias("event"), F.lit(s).alias("node")) for k, (e, s) in enumerate(named, 1)])
    end = failed.groupBy("query_id").agg(F.min(F.coalesce(*[F.when(F.col("node") == s, F.lit(2 * k + 2)) for k, s in enumerate(steps)])).alias("end"))
    rows = questions.select("query_id").join(end, "query_id", "left").select("query_id", "end", F.explode(order).alias("e")).where("end is null or e.ordinal <= end")
    event = F.when(F.col("e.ordinal") == F.col("end"), "node_failed").otherwise(F.col("e.event"))
    return rows.select(F.col("query_id").alias("trace_id"), "e.ordinal", event.alias("event"), "e.node")
