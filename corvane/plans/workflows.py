"""Queries that run the whole workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import events
from corvane.plans import plugins, workflow
from corvane.plans.graphs import GRAPH_SQL, edges, vertices
from corvane.plans.retrieval import _bm25
from corvane.plans.tables import asked, chunks, kept_index, questions
from corvane.settings import GraphSettings, RetrievalSettings, Settings
from corvane.sources.shared import stored

CANDIDATES, FINAL = 16, 4


def _ask(corpus: workflow.Corpus, items: DataFrame) -> workflow.Answered:
    """Answers of the offline generator, from lexical retrieval alone."""
    settings = Settings(retrieval=RetrievalSettings(candidate_limit=CANDIDATES, final_limit=FINAL, vector_weight=0.0))
    return workflow.ask(corpus, items.withColumnRenamed("text", "question"), settings, graph_context=False)


def _answered(spark: SparkSession, d: str) -> workflow.Answered:
    """Answers to benchmark items."""
    return _ask(workflow.Corpus(chunks(spark, d), index=kept_index(spark, d)), asked(spark, d))


def workflow_answers(spark: SparkSession, d: str) -> DataFrame:
    found = _answered(spark, d).answers
    return found.select("query_id", "answer", F.array_join("cited_evidence_ids", ",").alias("cited"), "answer_basis", F.array_join("notices", "; ").alias("notices"))


def workflow_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the answers to all benchmark items. As they are one batch of many common words, chunks are scored where they are read, without an index."""
    found = _ask(workflow.Corpus(chunks(spark, d)), questions(spark, d)).citations
    return found.withColumn("score", F.round("score", 9))


def workflow_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """What the snapshots after each step say: the numbers of basis and severity, the controls of retrieval, and what was found."""
    rows, at = _answered(spark, d).checkpoints, lambda path: F.get_json_object("context_snapshot", f"$.{path}")
    number = lambda path: at(path).cast("int")
    return rows.select(
        "trace_id", "sequence_ordinal", "node_name", F.size(F.json_object_keys("context_snapshot")).alias("n_keys"), number("answer_basis").alias("answer_basis"), number("notices[0].severity").alias("severity"), at("final_candidates").alias("final_candidates"),
        number("snapshot.rrf_k").alias("rrf_k"), number("snapshot.candidate_limit").alias("candidate_limit"), number("snapshot.final_limit").alias("final_limit"), number("snapshot.variant_count").alias("variant_count"),
        at("snapshot.vector_weight").cast("double").alias("vector_weight"), at("snapshot.result_hash").alias("result_hash"), at("snapshot.index_generation").alias("index_generation"), F.json_array_length(at("evidence_blocks")).alias("n_evidence"),
        number("structured_citations[0].rank").alias("cited_rank"), at("original_query").alias("original_query"), at("variants").isNotNull().alias("has_variants"),
    )


def workflow_responses(spark: SparkSession, d: str) -> DataFrame:
    """What a client gets of each answer: its fields, without those of the variants."""
    last = _answered(spark, d).checkpoints.where("node_name = 'post_GenerateAnswer'")
    rows, at = last.select("trace_id", events.response(F.col("context_snapshot")).alias("r")), lambda path: F.get_json_object("r", f"$.{path}")
    keys = lambda path: F.array_join(F.json_object_keys(at(path) if path else F.col("r")), ",")
    return rows.select("trace_id", at("answer").alias("answer"), at("citations").alias("citations"), at("answer_basis").cast("int").alias("answer_basis"), F.json_array_length(at("structured_citations")).alias("n_cited"),
                       at("notices[0].typed_code").cast("int").alias("typed_code"), keys("").alias("fields"), keys("snapshot").alias("controls"), at("snapshot.result_hash").alias("result_hash"))


class LetterShares:
    """An embedder that SQL can repeat: the shares of some letters in a text."""

    model, letters = "letter-shares", "aeinorst"

    def embed(self, text: Column) -> Column:
        low = F.lower(text)
        return F.array(*[((F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))) / F.greatest(F.length(low), F.lit(1))).cast("float") for c in self.letters])


def _run_with_graph(spark: SparkSession, d: str) -> workflow.Answered:
    embedder, own = LetterShares(), chunks(spark, d)
    corpus = workflow.Corpus(own.withColumn("embedding", embedder.embed(F.col("content"))), vertices(spark, d).withColumn("name_vector", embedder.embed(F.col("name"))), edges(spark, d), kept_index(spark, d))
    settings = Settings(retrieval=RetrievalSettings(candidate_limit=CANDIDATES, final_limit=FINAL), graph=GraphSettings(seed_match_min_score=0.1))
    return workflow.ask(corpus, asked(spark, d).withColumnRenamed("text", "question"), settings, embedder=embedder)


def workflow_graph_facts(spark: SparkSession, d: str) -> DataFrame:
    """The facts that the graph step of a run with dense retrieval noted in its snapshot."""
    rows = _run_with_graph(spark, d).checkpoints.where("node_name = 'post_ExtractGraphContext'")
    of = "array<struct<fact: struct<entity_a_name: string, relation_type: string, entity_b_name: string, edge_summary: string, score: double>>>"
    facts = rows.select("trace_id", F.explode(F.from_json(F.get_json_object("context_snapshot", "$.graph_facts"), of)).alias("f"))
    return facts.select("trace_id", "f.fact.*").withColumn("score", F.round("score", 9))


def workflow_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of a run with all of its parts: dense retrieval and the whole graph beside the lexical lists."""
    embedder = plugins.HashEmbedder()
    corpus = workflow.Corpus(
        stored(chunks(spark, d).withColumn("embedding", embedder.embed(F.col("content"))), "embedded"), vertices(spark, d).withColumn("name_vector", embedder.embed(F.col("name"))), edges(spark, d), kept_index(spark, d)
    )
    items = asked(spark, d).withColumnRenamed("text", "question")
    settings = Settings(retrieval=RetrievalSettings(candidate_limit=CANDIDATES, final_limit=FINAL), graph=GraphSettings(seed_match_min_score=0.1))
    return workflow.ask(corpus, items, settings, embedder=embedder).events


QUERIES = {f.__name__: f for f in (workflow_answers, workflow_citations, workflow_checkpoints, workflow_responses, workflow_graph_facts, workflow_events)}

def _found(every: bool = False) -> str:
    return f"""{_bm25(limit=CANDIDATES, every=every)},
found AS (
  SELECT b.query_id, b.rank, c.* EXCLUDE (content_type), c.content_type, 1 / (60.0 + b.rank) AS score, '[' || b.rank || ']' AS id, rtrim(regexp_extract(c.content, '(?s)^[^.!?]{{0,200}}')) AS sentence,
         regexp_extract(c.content, '(?s)^[^.!?]{{0,200}}') || ' [' || b.rank || ']' AS said
  FROM bm25 b JOIN chunks c USING (chunk_id) WHERE b.rank <= 2)"""


def _shares(text: str) -> str:
    return "[" + ", ".join(f"CAST((length({text}) - length(replace(lower({text}), '{c}', ''))) / CAST(greatest(length({text}), 1) AS DOUBLE) AS FLOAT)" for c in LetterShares.letters) + "]"


SQL = {
    "workflow_answers": f"""WITH {_found()}
SELECT query_id, string_agg(said, '. ' ORDER BY rank) AS answer, string_agg(id, ',' ORDER BY rank) AS cited, 'retrieval' AS answer_basis, '{workflow.ABLATION}' AS notices FROM found GROUP BY query_id""",
    "workflow_citations": f"""WITH {_found(every=True)}
SELECT query_id, CAST(rank - 1 AS INTEGER) AS ordinal, id AS marker_id, chunk_id, document_id, title, section_path,
       'document_id=' || document_id || ', chunk_index=' || chunk_index || ', title="' || title || '", section="' || section_path || '"' AS provenance,
       substring(content, 1, 512) AS excerpt, length(content) > 512 AS is_truncated, round(score, 9) AS score, rank, content_type FROM found""",
    "workflow_checkpoints": f"""WITH {_bm25(limit=CANDIDATES)},
f AS (SELECT query_id, '[' || string_agg('"' || chunk_id || '"', ',' ORDER BY rank) || ']' AS ids, sha256(string_agg(chunk_id || chr(0), '' ORDER BY rank)) AS hash, count(*) AS n FROM bm25 WHERE rank <= {FINAL} GROUP BY query_id),
steps AS (SELECT unnest([{", ".join(f"'{s}'" for s in workflow.STEPS)}]) AS node, unnest(range(1, {len(workflow.STEPS) + 1})) AS k)
SELECT CAST(item_id AS VARCHAR) AS trace_id, CAST(k AS INTEGER) AS sequence_ordinal, 'post_' || node AS node_name, 19 AS n_keys, CASE WHEN k = 5 THEN 1 ELSE 0 END AS answer_basis, CASE WHEN k = 5 THEN 1 END AS severity,
       CASE WHEN k >= 3 THEN ids ELSE '[]' END AS final_candidates, CASE WHEN k >= 3 THEN 60 END AS rrf_k, CASE WHEN k >= 3 THEN {CANDIDATES} END AS candidate_limit, CASE WHEN k >= 3 THEN {FINAL} END AS final_limit,
       CASE WHEN k >= 3 THEN 1 END AS variant_count, CASE WHEN k >= 3 THEN CAST(0 AS DOUBLE) END AS vector_weight, CASE WHEN k >= 3 THEN hash END AS result_hash, CASE WHEN k >= 3 THEN 'unversioned' END AS index_generation,
       CAST(CASE WHEN k >= 3 THEN n ELSE 0 END AS INTEGER) AS n_evidence, CASE WHEN k = 5 THEN 1 END AS cited_rank, text AS original_query, TRUE AS has_variants
FROM benchmark JOIN f ON query_id = item_id, steps WHERE item_id % 20 = 0""",
    "workflow_responses": f"""WITH {_found()},
h AS (SELECT query_id, sha256(string_agg(chunk_id || chr(0), '' ORDER BY rank)) AS result_hash FROM bm25 WHERE rank <= {FINAL} GROUP BY query_id)
SELECT CAST(query_id AS VARCHAR) AS trace_id, string_agg(said, '. ' ORDER BY rank) AS answer, '["' || string_agg(id, '","' ORDER BY rank) || '"]' AS citations, 1 AS answer_basis, CAST(count(*) AS INTEGER) AS n_cited, 18 AS typed_code,
       'answer,citations,session_id,answer_basis,structured_citations,notices,snapshot' AS fields, 'index_generation,embedding_model,vector_weight,bm25_weight,rrf_k,candidate_limit,final_limit,active_filter,result_hash' AS controls, any_value(result_hash) AS result_hash
FROM found JOIN h USING (query_id) GROUP BY query_id""",
    "workflow_graph_facts": f"""WITH {GRAPH_SQL},
named AS (SELECT id AS entity_id, {_shares("name")} AS v FROM v),
q AS (SELECT item_id AS query_id, {_shares("text")} AS v FROM benchmark WHERE item_id % 20 = 0),
near AS (
  SELECT query_id, entity_id, round(list_sum(list_transform(list_zip(n.v, q.v), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))), 9) AS d FROM named n, q
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, entity_id) = 1),
found AS (SELECT query_id, 1 / (1 + d) AS score, e.* FROM near JOIN e ON entity_id IN (s, t) WHERE 1 / (1 + d) >= 0.1),
few AS (SELECT query_id FROM found GROUP BY 1 HAVING count(*) <= 200)
SELECT CAST(query_id AS VARCHAR) AS trace_id, a.name AS entity_a_name, relation_type, b.name AS entity_b_name, CAST(NULL AS VARCHAR) AS edge_summary, round(score * CAST(weight AS DOUBLE), 9) AS score
FROM found JOIN few USING (query_id) JOIN v a ON a.id = s JOIN v b ON b.id = t""",
    "workflow_events": f"""WITH steps AS (SELECT unnest([{", ".join(f"'{s}'" for s in workflow.STEPS)}]) AS node, unnest(range(1, {len(workflow.STEPS) + 1})) AS k),
every AS (
  SELECT 2 * k - 1 AS ordinal, 'node_started' AS event, node FROM steps UNION ALL SELECT 2 * k, 'node_completed', node FROM steps
  UNION ALL SELECT * FROM (VALUES (11, 'answer_chunk', ''), (12, 'final_answer', ''), (13, 'workflow_completed', '')) x)
SELECT item_id AS trace_id, CAST(ordinal AS INTEGER) AS ordinal, event, node FROM benchmark, every WHERE item_id % 20 = 0""",
}
