"""The question-answering workflow and the ingestion workflow, for batches.

Steps, in order: reformulate, graph context, hybrid retrieval, prompt assembly, generation with
citation repair. Each runs over all questions at once. Graph context and each source of retrieval may fail without
ending the run, which then goes on with a notice; what is wrong with one question ends that question alone.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.errors import TimedOut
from corvane.functions.text import chunk_strategy, content_type, lossy_text, trimmed
from corvane.operators import answer, chunking, dense, entities, fusion, graph, lexical, prompt, snapshot, state
from corvane.plans.plugins import CapitalisedNames, FirstSentences, FoldedNames, HashEmbedder, KeepOrder, Retriever, RetryingGenerator, SameQuestion
from corvane.settings import MAX_VARIANTS, Filters, Settings, Timeouts
from corvane.sources.shared import stored

STEPS = ("ReformulateQuery", "ExtractGraphContext", "RetrieveHybrid", "AssemblePrompt", "GenerateAnswer")
# What notices say.
NO_EVIDENCE = "No completed corpus evidence matched the requested filters."
MODEL_ONLY = "Answer generated from parametric model knowledge without corpus evidence."
NO_GRAPH = "Graph context is not configured; answer produced from source chunks only"
NO_FACTS = "Graph query returned no facts for this query"
ABLATION = "Graph context disabled by caller request"


@dataclass
class Corpus:
    """``chunks`` with embeddings; the entity graph and a retriever of the chunks, such as their kept index, may be missing. ``generation`` names the state of the corpus."""

    chunks: DataFrame
    vertices: DataFrame | None = None
    edges: DataFrame | None = None
    index: Retriever | None = None
    generation: str = "unversioned"


@dataclass
class Answered:
    """What a run gives: a row in ``answers`` or in ``failures`` (``query_id, node, kind, message``) for each question.

    ``notices``: ``query_id, ordinal, code, message, severity``; ``events``: each question's run in order; ``checkpoints``: the context after each step as JSON.
    """

    answers: DataFrame
    citations: DataFrame
    evidence: DataFrame
    failures: DataFrame
    notices: DataFrame
    events: DataFrame
    checkpoints: DataFrame
    steps: list[str] = field(default_factory=lambda: list(STEPS))


class _Log:
    """Notices and failures of a run, as frames that are put together at its end."""

    def __init__(self, questions: DataFrame):
        self.questions, self.notes, self.bad = questions, [], []

    def say(self, step: int, rows: DataFrame, code: str, message: Column | str) -> None:
        text = F.lit(message) if isinstance(message, str) else message
        self.notes.append(rows.select("query_id", F.lit(step).alias("step"), F.lit(len(self.notes)).alias("seq"), F.lit(code).alias("code"), text.alias("message")))

    def fail(self, step: int, rows: DataFrame, kind: Column | str, message: Column) -> None:
        """These questions end here; a question's first failure counts."""
        what = F.lit(kind) if isinstance(kind, str) else kind
        self.bad.append(rows.select("query_id", F.lit(STEPS[step]).alias("node"), what.alias("kind"), message.alias("message")))

    def alive(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, bad: df.join(bad.select("query_id"), "query_id", "left_anti"), self.bad, rows)

    def failures(self) -> DataFrame:
        none = self.questions.select("query_id", F.lit("").alias("node"), F.lit("").alias("kind"), F.lit("").alias("message")).limit(0)
        return reduce(DataFrame.unionByName, self.bad, none)

    def notices(self) -> DataFrame:
        none = self.questions.select("query_id", F.lit(0).alias("step"), F.lit(0).alias("seq"), F.lit("").alias("code"), F.lit("").alias("message")).limit(0)
        rows = reduce(DataFrame.unionByName, self.notes, none)
        numbered = rows.withColumn("ordinal", F.struct("step", "seq", "message"))
        return answer.distinct_notices(numbered)


def _reason(error: Exception) -> str:
    return (str(error).strip().splitlines() or [type(error).__name__])[0][:200]


@contextmanager
def cancelled_when_left(spark):
    """Jobs that are started within, also by threads that outlive it, are cancelled when it is left, as when nobody waits for a stream any more."""
    tag = f"corvane-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)
        spark.sparkContext.cancelJobsWithTag(tag)


def _cancelling(run):
    """A run after whose end, by whatever cause, none of its jobs goes on."""

    @wraps(run)
    def inner(corpus: Corpus, questions: DataFrame, *args, **kwargs) -> Answered:
        with cancelled_when_left(questions.sparkSession):
            return run(corpus, questions, *args, **kwargs)

    return inner


@_cancelling
def ask(
    corpus: Corpus, questions: DataFrame, settings: Settings | None = None, filters: Filters | None = None, embedder=None, reformulator=None, reranker=None, generator=None,
    graph_context: bool = True, analyzer=lexical.plain_terms, timeouts: Timeouts | None = None, sink=None, session_id: str = "",
) -> Answered:
    """Answer ``questions`` (``query_id, question``).

    Dense retrieval takes the first variant only; each variant has its lexical list. Without any evidence the last two steps are
    left out unless model-only answers are allowed. With ``timeouts`` a step that takes longer is cancelled: graph context and sources of retrieval degrade, any
    other step ends the run; without, a batch takes as long as it needs. ``sink`` gets the checkpoints. A kept index of the corpus has its own analyzer.
    """
    s, spark = settings or Settings(), questions.sparkSession
    embedder, reformulator = embedder or HashEmbedder(), reformulator or SameQuestion()
    reranker, generator = reranker or KeepOrder(), RetryingGenerator(generator or FirstSentences())
    questions = stored(questions.select("query_id", "question"), "questions")
    log = _Log(questions)
    timed = lambda name, run: with_time_limit(spark, getattr(timeouts, name) / 1000, run) if timeouts else run()

    odd = (F.length(trimmed(F.col("question"))) == 0) | (F.octet_length("question") > s.retrieval.query_max_bytes) | F.col("question").isNull()
    log.fail(0, questions.where(odd), "invalid_query", F.lit("the query is empty or too long"))
    live = log.alive(questions)
    variants = timed("reformulate", lambda: stored(reformulator.variants(live), "variants"))
    counts = live.join(variants.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    log.fail(0, counts.where(~F.coalesce(F.col("n").between(1, MAX_VARIANTS), F.lit(False))), "invalid_query", F.format_string(f"%d variants; 1 to {MAX_VARIANTS} are allowed", F.coalesce("n", F.lit(0))))
    live, variants = stored(log.alive(live), "live"), log.alive(variants)

    # an embedding that fails ends the run
    vectors = timed("embedding", lambda: stored(variants.where("variant = 0").select("query_id", embedder.embed(F.col("text")).alias("vector")), "vectors"))
    facts = _graph_context(corpus, live, vectors, s, log, graph_context, timed)
    lists = _lists(corpus, variants, vectors, s, filters, log, analyzer, timed)
    wrong = lists.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).select("query_id").distinct()
    log.fail(2, wrong, "non_finite_score", F.lit("a source gave a score that is no finite number"))
    lists = log.alive(lists)
    fused = stored(reranker.rerank(fusion.fuse_variants(fusion.fuse(lists, s.retrieval), s.retrieval)), "fused")
    results = corpus.chunks.drop("document_id", "chunk_index").join(fusion.final(fused, s.retrieval.final_limit), "chunk_id")
    blocks = stored(prompt.evidence(results), "blocks")
    have = blocks.select("query_id").distinct()
    bare, with_evidence = log.alive(live.join(have, "query_id", "left_anti")), live.join(have, "query_id", "left_semi")
    log.say(2, bare, "NO_EVIDENCE", NO_EVIDENCE)

    def assembled() -> tuple[DataFrame, DataFrame]:
        out, failed = prompt.assemble_each(with_evidence, blocks, facts, s.retrieval.graph_weight, s.grounding.evidence_tokens, s.grounding.output_tokens)
        return stored(out, "packed"), stored(failed, "unpacked")

    packed, failed = timed("assemble", assembled)
    log.fail(3, failed, F.col("kind"), F.col("message"))
    number = packed.select("query_id", F.posexplode("evidence_ids").alias("_p", "id"))
    used = stored(blocks.join(number, ["query_id", "id"]), "used")
    texts = used.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "text"))), lambda x: x["text"]).alias("texts"))
    given = packed.join(texts, "query_id").select("query_id", "prompt", "evidence_ids", "texts")
    nothing = F.array().cast("array<string>")
    if s.allow_model_only:
        given = given.unionByName(bare.select("query_id", prompt.model_only_prompt(F.col("question")).alias("prompt"), nothing.alias("evidence_ids"), nothing.alias("texts")))
        log.say(4, bare, "MODEL_ONLY", MODEL_ONLY)
    raw = timed("generate", lambda: generator.answer(given))
    if "failure" in raw.columns:
        log.fail(4, raw.where("failure is not null"), "malformed_reply", F.col("failure"))
        raw = raw.where("failure is null").drop("failure")
    for code, name in (("MODEL_NOTICE", "notices"), ("MODEL_WARNING", "warnings")):
        log.say(4, raw.select("query_id", F.explode(name).alias("m")), code, F.col("m"))
    fixed = raw.withColumn("total_drop", F.lit(False))
    if s.citation_repair:
        repaired = stored(answer.repair(raw, used), "repaired")
        notes = repaired.select("query_id", F.explode("notices").alias("m"))
        log.say(4, notes.where(F.col("m").contains("' repaired to '")), "CITATION_REPAIRED", F.col("m"))
        log.say(4, notes.where(~F.col("m").contains("' repaired to '")), "CITATION_DROPPED", F.col("m"))
        fixed = raw.drop("answer", "cited_evidence_ids").join(repaired.drop("notices"), "query_id")
    judged = fixed.join(given.select("query_id", F.col("evidence_ids").alias("known_ids")), "query_id")
    judged = judged.withColumn("answer_basis", F.when(F.col("total_drop"), "model_only").otherwise(F.col("answer_basis")))
    judged = judged.withColumn("allow_model_only", F.lit(s.allow_model_only) | F.col("total_drop"))
    judged = stored(judged.withColumn("broken", answer.grounding_failure(s.grounding)), "judged")
    log.fail(4, judged.where("broken is not null"), "grounding", F.col("broken"))
    good = judged.where("broken is null")
    basis, _ = answer.reconciled_basis(F.col("answer_basis"), F.col("cited_evidence_ids"))
    log.say(4, good.withColumn("m", answer.basis_notice(F.col("answer_basis"), F.col("cited_evidence_ids"))).where("m is not null"), "BASIS_RECONCILED", F.col("m"))
    answers = good.select("query_id", "answer", "cited_evidence_ids", basis.alias("answer_basis"))
    if not s.allow_model_only:
        answers = answers.unionByName(bare.select("query_id", F.lit("").alias("answer"), nothing.alias("cited_evidence_ids"), F.lit("model_only").alias("answer_basis")))
    notices, failures = stored(log.notices(), "notices"), stored(log.failures(), "failures")
    said = notices.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "message"))), lambda x: x["message"]).alias("notices"))
    answers = stored(answers.join(said, "query_id", "left").withColumn("notices", F.coalesce("notices", nothing)), "answers")
    cited = answers.select("query_id", F.posexplode("cited_evidence_ids").alias("ordinal", "raw_id"))
    citations = answer.resolve_citations(cited, used, s.excerpt_chars)
    final = fusion.final(fused, s.retrieval.final_limit)
    facts_of_run = _snapshot(corpus, s, embedder.model, filters, variants, final)
    contexts = _contexts(live, session_id, filters, variants, vectors, facts, lists, final, blocks, packed, answers, citations, notices, facts_of_run)
    checkpoints = snapshot.snapshots(contexts, STEPS)
    if sink is not None:
        sink.write(checkpoints)
    return Answered(answers, citations, used.drop("_p"), failures, notices, snapshot.step_events(questions, STEPS, failures), checkpoints)


def _graph_context(corpus: Corpus, live: DataFrame, vectors: DataFrame, s: Settings, log: _Log, wanted: bool, timed) -> DataFrame | None:
    """Facts of each question, or none; why there are none is noted."""
    if not wanted:
        log.say(1, live, "GRAPH_ABLATION", ABLATION)
        return None
    if corpus.vertices is None:
        log.say(1, live, "GRAPH_UNAVAILABLE", NO_GRAPH)
        return None

    def found() -> tuple[DataFrame, DataFrame]:
        seeds = stored(graph.nearest_seed(corpus.vertices, vectors, s.graph.seed_match_min_score), "seeds")
        fine, over = graph.within_limits(corpus.edges, seeds, 1)
        return stored(graph.facts(corpus.vertices, corpus.edges, fine, max_edges=None, max_frontier=None), "facts"), over

    try:
        facts, over = timed("graph_operation", found)
    except TimedOut:
        log.say(1, live, "GRAPH_TIMEOUT", "GRAPH_TIMEOUT")
        return None
    except Exception as error:  # whatever the graph fails with, the answer goes without it
        log.say(1, live, "GRAPH_DEGRADED", f"graph_degrade: {_reason(error)}")
        return None
    log.say(1, over, "GRAPH_DEGRADED", F.concat(F.lit("graph_degrade: "), "message"))
    known = facts.select("query_id").union(over.select("query_id"))
    log.say(1, live.join(known, "query_id", "left_anti"), "GRAPH_UNAVAILABLE", NO_FACTS)
    return facts


def _lists(corpus: Corpus, variants: DataFrame, vectors: DataFrame, s: Settings, filters: Filters | None, log: _Log, analyzer, timed) -> DataFrame:
    """The ranked lists of both sources. A source that fails gives empty lists and a notice; if the joint lexical search fails, each variant is tried alone."""
    limit, columns = s.retrieval.candidate_limit, ["query_id", "variant", "source", *lexical.KEY, "score"]

    def words(rows: DataFrame) -> DataFrame:
        # the variants' lists come from one search, told apart by a joint key
        joint = rows.select(F.struct("query_id", "variant").alias("query_id"), "text")
        found = corpus.index.search(joint, limit, filters, s.bm25) if corpus.index else lexical.search(corpus.chunks, joint, limit, filters, s.bm25, analyzer)
        return stored(found.select("query_id.query_id", "query_id.variant", F.lit("bm25").alias("source"), *lexical.KEY, "score"), "words")

    def near() -> DataFrame:
        found = stored(dense.search(corpus.chunks, vectors, limit, filters), "near")
        dense.check_rows(found)
        return found.select("query_id", F.lit(0).alias("variant"), F.lit("vector").alias("source"), *lexical.KEY, "score")

    lists = []
    if s.retrieval.vector_weight > 0:
        try:
            lists.append(timed("retrieve", near))
        except Exception as error:  # whatever a source fails with, the other one answers
            log.say(2, vectors, "RETRIEVAL_DEGRADED_DENSE", _reason(error))
    try:
        lists.append(timed("retrieve", lambda: words(variants)))
    except Exception:
        for v in sorted(r["variant"] for r in variants.select("variant").distinct().collect()):
            own = variants.where(F.col("variant") == v)
            try:
                lists.append(timed("retrieve", lambda own=own: words(own)))
            except Exception as error:
                log.say(2, own, "RETRIEVAL_DEGRADED_BM25", _reason(error))
    if not lists:
        keys = corpus.chunks.select(*lexical.KEY).limit(0)
        return variants.select("query_id", "variant", F.lit("").alias("source")).limit(0).crossJoin(keys).withColumn("score", F.lit(0.0))
    return reduce(DataFrame.unionByName, [rows.select(*columns) for rows in lists])


def _filter(filters: Filters | None) -> Column:
    if not filters:
        return F.lit(None).cast("struct<document_ids: array<string>, content_types: array<string>>")
    return F.struct(*[F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in (("document_ids", filters.document_ids), ("content_types", filters.content_types))])


def _texts(df: DataFrame, name: str, order: list, value: Column) -> DataFrame:
    """Of each question the values in order, as one list."""
    return df.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("_value")))), lambda x: x["_value"]).alias(name))


def _snapshot(corpus: Corpus, s: Settings, model: str, filters: Filters | None, variants: DataFrame, final: DataFrame) -> DataFrame:
    """``query_id, snapshot``: what a question's retrieval was controlled by and what it gave."""
    r = s.retrieval
    names = _texts(variants, "variant_identities", ["variant"], F.col("text"))
    rows = names.join(fusion.result_hash(final), "query_id", "left")
    none = F.sha2(F.lit(b""), 256)  # of no result
    body = F.struct(
        F.lit(corpus.generation).alias("index_generation"), F.lit(model).alias("embedding_model"), F.lit(float(r.vector_weight)).alias("vector_weight"), F.lit(float(r.bm25_weight)).alias("bm25_weight"), F.lit(int(r.rrf_k)).alias("rrf_k"),
        F.lit(int(r.candidate_limit)).alias("candidate_limit"), F.lit(int(r.final_limit)).alias("final_limit"), _filter(filters).alias("active_filter"), F.coalesce("result_hash", none).alias("result_hash"),
        F.size("variant_identities").alias("variant_count"), "variant_identities",
    )
    return rows.select("query_id", body.alias("snapshot"))


def _contexts(live, session_id, filters, variants, vectors, facts, lists, final, blocks, packed, answers, citations, notices, snapshots) -> DataFrame:
    """One row a question with all keys of a snapshot."""
    ids = lambda df, name, *order: _texts(df, name, list(order), F.col("chunk_id"))
    down = F.col("score") * -1
    order = [down.alias("_a"), F.col("edge_id").alias("_b")]
    if facts is None:
        facts = live.select("query_id", *[F.lit("").alias(c) for c in ("edge_id", "entity_a", "relation_type", "entity_b", "edge_summary")], F.lit(0.0).alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id", "variant", "source").orderBy(F.desc("score"), *lexical.KEY))
    ranked = lists.withColumn("_rank", rank)
    shown = F.struct(F.struct(F.col("entity_a").alias("entity_a_name"), "relation_type", F.col("entity_b").alias("entity_b_name"), "edge_summary", "score").alias("fact"))
    cited = F.struct(*[F.coalesce(c, F.lit("")).alias(c) if c in ("title", "section_path", "content_type") else F.col(c) for c in snapshot.CITED])
    parts = [
        _texts(variants, "variants", ["variant"], F.col("text")),
        vectors.select("query_id", snapshot.digest(F.col("vector")).alias("query_embedding")),
        _texts(facts, "graph_facts", order, shown),
        facts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, graph.render_fact("dashes").alias("_line")))), lambda x: x["_line"]), "\n").alias("graph_context")),
        ids(ranked.where("source = 'vector'"), "vector_results", "_rank"),
        ids(ranked.where("source = 'bm25'"), "bm25_results", "variant", "_rank"),
        ids(final, "final_candidates", "rank"),
        _texts(blocks, "evidence_blocks", ["rank"], F.struct(*snapshot.EVIDENCE)),
        packed.select("query_id", F.col("prompt").alias("assembled_prompt")),
        answers.select("query_id", "answer", F.col("cited_evidence_ids").alias("citations"), snapshot.number(F.col("answer_basis"), snapshot.BASIS_NUMBERS).alias("answer_basis")),
        _texts(citations, "structured_citations", ["ordinal"], cited),
        _texts(notices, "notices", ["ordinal"], F.struct("code", "message", snapshot.number(F.col("severity"), snapshot.SEVERITY_NUMBERS).alias("severity"))),
        snapshots,
    ]
    rows = live.select("query_id", F.lit(session_id).alias("session_id"), F.col("query_id").cast("string").alias("trace_id"), F.col("question").alias("original_query"), _filter(filters).alias("filter"))
    return snapshot.side_by_side([rows, *parts], "query_id")


def ingest(store, staged: DataFrame, embedder=None, extractor=None, now: int = 0, resolver=None) -> DataFrame:
    """Ingest staged documents: chunks, vectors, chunk edges, then entities and their edges.

    Returns ``document_id, status, message``. Documents are replaced in one commit and the graph in another. If the first fails the documents have failed and are
    unstaged; if they can't be unstaged either, they stay staged without a status, to be replayed. A failure of the second is told in the message, and the
    documents are complete.
    """
    embedder, extractor, resolver = embedder or HashEmbedder(), extractor or CapitalisedNames(), resolver or FoldedNames()
    docs = staged.select(
        "document_id", "filename", "raw_content", lossy_text(F.col("raw_content")).alias("content"), content_type(F.col("filename")).alias("content_type"),
        chunk_strategy(F.col("filename"), F.col("chunk_strategy")).alias("strategy"), "chunk_size", "chunk_overlap",
    )
    ids = stored(docs.select("document_id").distinct(), "ids")
    status = lambda name, message: ids.select("document_id", F.lit(name).alias("status"), F.lit(message).cast("string").alias("message"))
    try:
        docs = stored(docs, "docs")
        chunks = stored(chunking.chunk_documents(docs), "chunks")
        lexical.check_rows(chunks.where(F.length(trimmed(F.col("content"))) > 0))
        full = chunks.withColumn("embedding", embedder.embed(F.col("content"))).withColumn("embedding_model", F.lit(embedder.model))
        store.replace_documents(docs.select("document_id", "raw_content"), full, chunking.chunk_edges(chunks), now, embedder.model)
    except Exception as error:
        try:
            store.unstage(ids)
        except Exception:
            return status("queued", "").limit(0)
        return status("failed", _reason(error))
    try:
        fewer = _extract(store, ids, embedder, extractor, resolver)
    except Exception as error:
        return status("completed", f"graph: {_reason(error)}")
    told = fewer.select("document_id", F.format_string("graph: %d edges, fewer than the %d before", "written", "prior").alias("_fewer"))
    return status("completed", None).join(told, "document_id", "left").select("document_id", "status", F.col("_fewer").alias("message"))


def _extract(store, ids: DataFrame, embedder, extractor, resolver) -> DataFrame:
    """Write the entities and edges of the documents. Returns ``document_id, prior, written`` of those that have fewer edges than before."""
    own = store.table("nodes").join(ids, "document_id", "left_semi")
    found = extractor.extract(entities.extractable(own))
    found = stored(found.where(entities.valid_output(F.col("entities"), F.col("relations"))), "extracted")
    keys = ["document_id", "chunk_id", "chunk_index"]
    named = found.select(*keys, F.posexplode("entities").alias("pos", "e")).select(*keys, "pos", "e.*")
    related = found.select(*keys, F.posexplode("relations").alias("pos", "r")).select(*keys, "pos", "r.*")
    resolved = resolver.resolve(named, store.table("entities"))
    old = store.table("entities").select("entity_id", F.col("name_vector").alias("_v"))
    rows = resolved.join(old, "entity_id", "left").withColumn("name_vector", F.coalesce("_v", embedder.embed(F.col("name")))).drop("_v")
    rows = stored(rows, "entities")
    before = stored(store.table("entity_edges").join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n")), "edges-before")
    store.upsert_graph(ids, rows, entities.mapped_relations(related, named, resolved))
    after = store.table("entity_edges").join(ids, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("n"))
    return stored(entities.fewer(before, after), "edges-fewer")


def replay(store, **kwargs) -> DataFrame | None:
    """Ingest what is still staged, as after a restart; a document that was ingested meanwhile is replaced by the same rows."""
    staged = stored(state.check_staged(store.table("staged_documents")), "replayed")
    return None if staged.isEmpty() else ingest(store, staged, **kwargs)


def with_time_limit(spark, seconds: float, run):
    """``run()`` with its Spark jobs cancelled once the time is over, which is an error of its own."""
    tag, over = f"corvane-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return run()
    except Exception as error:
        if over.is_set():
            raise TimedOut(f"cancelled after {seconds:g} seconds") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
