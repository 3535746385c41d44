"""Replies of a chat model: one choice that stopped by itself, a strict object, token counts within the limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import unknown_keys, valid_json
from corvane.settings import GroundingLimits

# The largest body of a reply in bytes, the fields of an answer, and the bases it may claim.
MAX_BODY_BYTES = 256 * 1024
FIELDS = ("answer", "cited_evidence_ids", "answer_basis", "notices", "warnings")
BASES = ("retrieval", "mixed", "model_only")
ANSWER = "answer string, cited_evidence_ids array<string>, answer_basis string, notices array<string>, warnings array<string>"
REPLY = "choices array<struct<finish_reason: string, message: struct<content: string>>>, usage struct<prompt_tokens: long, completion_tokens: long, total_tokens: long>"


def parsed(body: Column, limits: GroundingLimits | None = None) -> Column:
    """``failure`` (null if all is well), ``reply`` (the answer's fields) and ``usage`` of a reply's body.

    The first rule broken is named: ``too_large, wrapper, choices, unfinished, content, prompt_tokens, completion_tokens, total_tokens``.
    """
    limits = limits or GroundingLimits()
    wrapper = F.from_json(body, REPLY)
    choice = F.try_element_at(wrapper["choices"], F.lit(1))
    content, usage = choice["message"]["content"], wrapper["usage"]
    answer = F.from_json(content, ANSWER)
    raw = F.try_parse_json(content)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(raw, f"$.{name}", "variant"))
    strict = valid_json(content) & (F.size(unknown_keys(content, list(FIELDS))) == 0) & (F.size(F.json_object_keys(content)) == len(FIELDS)) & answer["answer_basis"].isin(*BASES)
    for name in ("answer", "answer_basis"):
        strict = strict & (kind(name) == "STRING")
    for name in ("cited_evidence_ids", "notices", "warnings"):
        strict = strict & kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>")
    given = usage.isNotNull()
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    spent = usage["prompt_tokens"] + usage["completion_tokens"]
    failure = F.coalesce(
        F.when(bad(F.octet_length(body) <= MAX_BODY_BYTES), "too_large"), F.when(bad(valid_json(body)), "wrapper"), F.when(bad(F.size(wrapper["choices"]) == 1), "choices"),
        F.when(bad(choice["finish_reason"] == "stop"), "unfinished"), F.when(bad(strict), "content"), F.when(given & bad(usage["prompt_tokens"] <= limits.evidence_tokens), "prompt_tokens"),
        F.when(given & bad(usage["completion_tokens"] <= limits.output_tokens), "completion_tokens"), F.when(given & bad(usage["total_tokens"].between(spent, limits.total_tokens)), "total_tokens"),
    )
    return F.struct(failure.alias("failure"), F.when(failure.isNull(), answer).alias("reply"), F.when(failure.isNull(), usage).alias("usage"))
