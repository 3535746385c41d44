"""Checks and repairs of answers: grounding rules, citations, answer basis, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.errors import GroundingFailed
from corvane.functions.text import ascii_marker, excerpt, inline_markers, loose_markers, trimmed
from corvane.settings import GroundingLimits

# Limits of an answer.
MAX_ANSWER_CHARS, MAX_CITED, MAX_ID_CHARS, MAX_NOTES, MAX_NOTE_CHARS = 16_384, 64, 128, 32, 1_024
#: Bases from the strongest to the weakest.
BASES = ("retrieval", "mixed", "model_only")
# The codes of notices; all but a model's warning are for information.
NOTICE_CODES = (
    "UNSPECIFIED", "NO_EVIDENCE", "GRAPH_TIMEOUT", "GRAPH_DEGRADED", "MODEL_NOTICE", "MODEL_WARNING", "GRAPH_UNAVAILABLE", "RETRIEVAL_DEGRADED_DENSE", "CITATION_REPAIRED",
    "CITATION_DROPPED", "MODEL_ONLY", "BASIS_RECONCILED", "RETRIEVAL_DEGRADED_BM25", "GRAPH_ABLATION", "INDEX_REBUILD_FAILED", "INDEX_STALE", "INDEX_GENERATION_MISMATCH",
)
NOTICES = {code: "warning" if code == "MODEL_WARNING" else "info" for code in NOTICE_CODES}


#: What a citation shows of its evidence.
SHOWN = ("chunk_id", "document_id", "title", "section_path", "provenance", "score", "rank", "content_type")


def grounding_rules(limits: GroundingLimits) -> list[tuple[str, Column]]:
    """Rules in the order in which they are held, each with when it is broken.

    Rows: ``answer, answer_basis, cited_evidence_ids, notices, warnings``, ``usage`` (struct of ``prompt_tokens,
    completion_tokens, total_tokens``, or null), ``known_ids`` and ``allow_model_only``.
    """
    cited, known, inline = F.col("cited_evidence_ids"), F.col("known_ids"), F.array_distinct(inline_markers(F.col("answer")))
    usage = lambda f: F.coalesce(F.col(f"usage.{f}"), F.lit(0))
    total = usage("total_tokens")
    spent = usage("prompt_tokens") + usage("completion_tokens")
    given = F.col("usage").isNotNull()
    long = lambda items, most: F.exists(items, lambda x: F.length(x) > most)
    return [
        ("model_only_not_allowed", ~F.col("allow_model_only") & (F.col("answer_basis") == "model_only")),
        ("answer_blank", F.length(trimmed(F.col("answer"))) == 0),
        ("answer_too_long", F.length("answer") > MAX_ANSWER_CHARS),
        ("no_citation", (F.size(cited) == 0) & (~F.col("allow_model_only") | (F.col("answer_basis") != "model_only"))),
        ("too_many_citations", F.size(cited) > MAX_CITED),
        ("citation_too_long", long(cited, MAX_ID_CHARS)),
        ("too_many_notices", F.size("notices") > MAX_NOTES),
        ("notice_too_long", long("notices", MAX_NOTE_CHARS)),
        ("too_many_warnings", F.size("warnings") > MAX_NOTES),
        ("warning_too_long", long("warnings", MAX_NOTE_CHARS)),
        ("prompt_tokens_over", given & (usage("prompt_tokens") > limits.evidence_tokens)),
        ("completion_tokens_over", given & (usage("completion_tokens") > limits.output_tokens)),
        ("total_tokens_wrong", given & ((total > limits.total_tokens) | (total < spent))),
        ("citation_repeated", F.size(F.array_distinct(cited)) < F.size(cited)),
        ("citation_unknown", F.size(F.array_except(cited, known)) > 0),
        ("marker_unknown", F.size(F.array_except(inline, known)) > 0),
        ("markers_differ", (F.size(F.array_except(inline, cited)) > 0) | (F.size(F.array_except(cited, inline)) > 0)),
    ]


def grounding_failure(limits: GroundingLimits | None = None) -> Column:
    """The first broken rule's name, or null for a grounded answer."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in grounding_rules(limits or GroundingLimits())])


def check_grounding(answers: DataFrame, limits: GroundingLimits | None = None) -> None:
    bad = answers.withColumn("_rule", grounding_failure(limits)).where("_rule is not null").select("_rule").first()
    if bad:
        raise GroundingFailed(bad["_rule"])


def resolve_markers(markers: DataFrame, evidence: DataFrame, form=ascii_marker) -> DataFrame:
    """Each marker's ``outcome`` (``unchanged``, ``repaired``, ``dropped``) and ``evidence_id``.

    ``markers``: ``query_id, ordinal, marker``; ``evidence``: ``query_id, id``. A marker resolves if its form is that of
    exactly one evidence id of its query; none or several drop it.
    """
    ids = evidence.select("query_id", F.col("id").alias("_id"), form(F.col("id")).alias("_form"))
    one = ids.groupBy("query_id", "_form").agg(F.count("*").alias("_n"), F.min("_id").alias("evidence_id")).where("_n = 1")
    rows = markers.withColumn("_form", form(F.col("marker"))).join(one, ["query_id", "_form"], "left")
    outcome = F.when(F.col("evidence_id").isNull(), "dropped").when(F.col("evidence_id") == F.col("marker"), "unchanged").otherwise("repaired")
    return rows.select("query_id", "ordinal", "marker", outcome.alias("outcome"), "evidence_id")


def answer_markers(answers: DataFrame) -> DataFrame:
    """Markers of each answer in order, from 0: ``query_id, ordinal, marker``."""
    return answers.select("query_id", F.posexplode(loose_markers(F.col("answer"))).alias("ordinal", "marker"))


def repair(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, answer, cited_evidence_ids, total_drop, notices``: answers with their markers repaired.

    Unresolved markers vanish; the citations are those that resolved, in the order of their first marker. ``total_drop`` says that there were
    markers and none resolved, so that the answer counts as the model's own. Each answer is rebuilt from what stands between its markers.
    """
    found = resolve_markers(answer_markers(answers), evidence)
    step = F.struct("ordinal", "marker", "outcome", "evidence_id")
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(step)).alias("_marks"))
    pattern = F.lit(r"\[[ \t\n\f\r]*[0-9]+[ \t\n\f\r]*\]")
    rows = answers.select("query_id", "answer").join(lists, "query_id", "left").withColumn("_marks", F.coalesce("_marks", F.expr("cast(array() as array<struct<ordinal:int,marker:string,outcome:string,evidence_id:string>>)")))
    between = F.split("answer", pattern, -1)
    pieces = F.zip_with(between, F.transform("_marks", lambda m: F.coalesce(m["evidence_id"], F.lit(""))), lambda t, m: F.concat(F.coalesce(t, F.lit("")), F.coalesce(m, F.lit(""))))
    kept = F.array_distinct(F.transform(F.filter("_marks", lambda m: m["evidence_id"].isNotNull()), lambda m: m["evidence_id"]))
    note = lambda m: F.when(
        m["outcome"] == "repaired", F.concat(F.lit("citation marker '"), m["marker"], F.lit("' repaired to '"), m["evidence_id"], F.lit("'"))
    ).otherwise(F.concat(F.lit("citation marker '"), m["marker"], F.lit("' could not be resolved and was dropped")))
    notes = F.array_distinct(F.transform(F.filter("_marks", lambda m: m["outcome"] != "unchanged"), note))
    return rows.select(
        "query_id", F.array_join(pieces, "").alias("answer"), kept.alias("cited_evidence_ids"), ((F.size("_marks") > 0) & (F.size(kept) == 0)).alias("total_drop"), notes.alias("notices")
    )


def reconciled_basis(reported: Column, cited: Column) -> tuple[Column, Column]:
    """The weaker of the reported basis and the observed one, and whether that is another one than reported.

    Observed: ``retrieval`` with citations, ``model_only`` without.
    """
    strength = F.when(reported == "retrieval", 2).when(reported == "mixed", 1).otherwise(0)
    basis = F.when(F.size(cited) == 0, "model_only").when(strength == 2, "retrieval").when(strength == 1, "mixed").otherwise("model_only")
    return basis, basis != reported


def basis_notice(reported: Column, cited: Column) -> Column:
    """The notice of a changed basis, else null."""
    basis, changed = reconciled_basis(reported, cited)
    observed = F.when(F.size(cited) == 0, "model_only").otherwise("retrieval")
    pattern = "model self-reported basis '%s' but the engine observed '%s'; reconciled to the more conservative basis '%s'"
    return F.when(changed, F.format_string(pattern, reported, observed, basis))


def resolve_citations(cited: DataFrame, evidence: DataFrame, chars: int = 512) -> DataFrame:
    """Citations with their excerpt: ``query_id, ordinal, marker_id, chunk_id, document_id, title, section_path, provenance, excerpt, is_truncated, score, rank, content_type``.

    ``cited``: ``query_id, ordinal, raw_id``, the id with or without brackets, or a chunk's id. The first evidence in rank that has
    the one or the other is meant. A citation stays unless an earlier one that stayed has its marker or its chunk. A missing content type is plain text.
    """
    raw = F.col("raw_id")
    bracketed = F.when(raw.startswith("[") & raw.endswith("]"), raw).otherwise(F.concat(F.lit("["), trimmed(raw), F.lit("]")))
    e = evidence.select("query_id", F.col("id").alias("marker_id"), *SHOWN, "text")
    asked = cited.withColumn("_id", bracketed)
    by_id = asked.join(e, (asked["_id"] == e["marker_id"]) & (asked["query_id"] == e["query_id"])).drop(e["query_id"])
    by_chunk = asked.join(e, (asked["raw_id"] == e["chunk_id"]) & (asked["query_id"] == e["query_id"])).drop(e["query_id"])
    best = Window.partitionBy("query_id", "ordinal").orderBy("rank")
    rows = by_id.unionByName(by_chunk).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    # a fold over the at most MAX_CITED citations of an answer, as what stays depends on what stayed before
    item = F.struct("ordinal", "marker_id", "chunk_id")
    lists = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    fold = """aggregate(_all, filter(_all, x -> false),
      (a, x) -> if(exists(a, y -> y.marker_id = x.marker_id or y.chunk_id = x.chunk_id), a, concat(a, array(x))))"""
    kept = lists.select("query_id", F.explode(F.expr(fold)).alias("_k")).select("query_id", "_k.ordinal")
    cut = excerpt(F.col("text"), chars)
    shown = ["document_id", "title", "section_path", "provenance"]
    return rows.join(kept, ["query_id", "ordinal"]).withColumn("_cut", cut).select(
        "query_id", "ordinal", "marker_id", "chunk_id", *shown, F.col("_cut.excerpt").alias("excerpt"), F.col("_cut.truncated").alias("is_truncated"), "score", "rank",
        F.coalesce("content_type", F.lit("text/plain")).alias("content_type"),
    )


def distinct_notices(notices: DataFrame) -> DataFrame:
    """Notices of a query without repeats of code and message, in order: ``query_id, ordinal, code, message, severity``."""
    first = Window.partitionBy("query_id", "code", "message").orderBy("ordinal")
    rows = notices.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    severity = F.lit(None).cast("string")
    for code, value in NOTICES.items():
        severity = F.when(F.col("code") == code, value).otherwise(severity)
    order = Window.partitionBy("query_id").orderBy("ordinal")
    return rows.select("query_id", F.row_number().over(order).alias("ordinal"), "code", "message", severity.alias("severity"))
