"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from corvane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = (
    "chunk_structure_aware", "chunk_edges_next_same_section", "bm25_topk", "bm25_topk_filtered_global_idf", "dense_topk_filtered", "cross_variant_rrf", "fusion_provenance",
    "graph_neighborhood_2hop", "graph_directed_confirm", "graph_facts_scored", "entity_resolution_fold", "relation_unmapped_anti", "evidence_blocks_provenance", "greedy_pack",
    "citation_repair", "grounding_check", "status_state_machine", "replace_document", "checkpoint_ordering", "store_inspection_facts", "stream_status_available_now",
    "prompt_assembled", "chunk_headings_sections", "unicode_terms_identifiers", "store_ingest_counts", "workflow_answers", "workflow_citations", "generator_reply_rules", "graph_limits_over", "dense_topk_case_sensitive",
    "upload_frames", "reconcile_create", "extractable_chunks", "html_escape",
    "index_postings", "bm25_topk_indexed", "privacy_fields", "stream_event_ordinals", "sse_workflow_frames", "graph_facts_summarised", "workflow_checkpoints",
)


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, con, data, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and ours == theirs and ours


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", ("bm25_topk", "bm25_topk_filtered_global_idf", "workflow_citations"))
def test_every_benchmark_item_is_a_question(spark, con, data, name):
    items = {r[0] for r in con.execute("select item_id from benchmark").fetchall()}
    found = {r[0] for r in registry.queries()[name](spark, data).select("query_id").distinct().collect()}
    assert len(items) > 20 and {int(x) for x in found} == items
