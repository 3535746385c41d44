"""Declared schemas of the store's tables, and the columns by which each is dealt into buckets."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, F32, B = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType(), T.BinaryType()  # noqa: E741
VECTOR = T.ArrayType(F32)


def _table(*columns: tuple) -> T.StructType:
    """Columns as (name, type) or (name, type, True) for nullable ones."""
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2) for c in columns])


_EDGE = _table(("edge_id", S), ("source_node_id", S), ("target_node_id", S), ("relation_type", S), ("weight", F32), ("document_id", S), ("summary", S, True), ("summary_vector", VECTOR, True))

SCHEMAS = {
    "documents": _table(("document_id", S), ("raw_content", B)),
    "nodes": _table(
        ("document_id", S), ("chunk_id", S), ("chunk_index", I), ("char_start", I), ("char_end", I), ("content", S), ("embedding", VECTOR), ("token_estimate", I),
        ("token_estimate_scheme", S), ("token_estimate_version", S), ("title", S, True), ("section_path", S, True), ("page_start", I, True), ("page_end", I, True),
        ("content_hash", S, True), ("chunker_version", S, True), ("embedding_model", S, True), ("ingested_at", L, True), ("content_type", S, True),
    ),
    "edges": _EDGE,
    "entities": _table(
        ("entity_id", S), ("name", S), ("entity_type", S), ("name_vector", VECTOR), ("summary", S, True), ("summary_vector", VECTOR, True),
        ("unsummarized_refs", T.ArrayType(S), True), ("community_ids", T.ArrayType(I), True), ("source_chunk_ids", T.ArrayType(S)),
    ),
    "entity_edges": _EDGE,
    "communities": _table(("community_id", I), ("level", I), ("title", S), ("summary", S), ("summary_vector", VECTOR), ("nodes", T.ArrayType(S))),
    "staged_documents": _table(("document_id", S), ("filename", S), ("raw_content", B), ("chunk_strategy", S), ("chunk_size", I), ("chunk_overlap", I), ("generation", L)),
}
#: A table's rows are dealt into buckets by this column, so that a change by it rewrites few of them.
BUCKETED_BY = {name: "document_id" for name in SCHEMAS} | {"entities": "entity_id", "communities": "community_id"}
#: The staged table before generations.
LEGACY_STAGED = T.StructType([f for f in SCHEMAS["staged_documents"].fields if f.name != "generation"])
