"""Seams for models, and stand-ins that need no network and give the same output each time."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.errors import InvalidQuery, InvalidSettings
from corvane.operators import entities, replies
from corvane.settings import MAX_VARIANTS, Bm25Settings, Filters, GroundingLimits
from corvane.sources.shared import stored


class Embedder(Protocol):
    model: str
    dimension: int

    def embed(self, text: Column) -> Column: ...


class Reformulator(Protocol):
    def variants(self, questions: DataFrame) -> DataFrame: ...


class Reranker(Protocol):
    def rerank(self, results: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    def answer(self, prompts: DataFrame) -> DataFrame: ...


class Extractor(Protocol):
    def extract(self, chunks: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    """Ranked chunks (``query_id``, the chunk's keys, ``score``) of ``queries`` (``query_id, text``), as a kept index gives them."""

    def search(self, queries: DataFrame, limit: int, filters: Filters | None = None, settings: Bm25Settings | None = None) -> DataFrame: ...


class EntityResolver(Protocol):
    """One row for each entity out of mentions and the known entities, as ``operators.entities.resolve`` gives."""

    def resolve(self, extracted: DataFrame, known: DataFrame) -> DataFrame: ...


class CheckpointSink(Protocol):
    """Where checkpoint rows (``trace_id, sequence_ordinal, node_name, context_snapshot``) go; a row may come twice."""

    def write(self, rows: DataFrame) -> None: ...


class MemorySink:
    """Checkpoints in memory, for tests: the last row of each trace and ordinal."""

    def __init__(self):
        self.rows: dict[tuple, tuple[str, str]] = {}

    def write(self, rows: DataFrame) -> None:
        for r in rows.collect():
            self.rows[r["trace_id"], r["sequence_ordinal"]] = (r["node_name"], r["context_snapshot"])


class TableSink:
    """Checkpoints in a Parquet folder, a numbered part for each write; of a trace and ordinal the row that was written last is read back."""

    def __init__(self, path: str):
        self.path, self.writes = path, time.time_ns()

    def write(self, rows: DataFrame) -> None:
        self.writes = max(self.writes + 1, time.time_ns())
        rows.withColumn("write", F.lit(self.writes)).write.mode("append").parquet(self.path)

    def read(self, spark) -> DataFrame:
        last = F.max_by(F.struct("node_name", "context_snapshot"), F.struct("write", "context_snapshot"))
        rows = spark.read.parquet(self.path).groupBy("trace_id", "sequence_ordinal").agg(last.alias("r"))
        return rows.select("trace_id", "sequence_ordinal", "r.*")


class TransientError(Exception):
    """A provider's failure that may pass: a time-out, a full queue, a broken connection."""


def is_transient(error: Exception) -> bool:
    """A transient failure, or a job that one of its tasks ended with."""
    return isinstance(error, TransientError) or TransientError.__name__ in str(error)


def with_retries(call, attempts: int, first_wait: float = 1.0, sleep=time.sleep):
    """``call()`` with up to ``attempts`` tries, the same each time; only transient failures are tried again, after doubling waits."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts or not is_transient(error):
                raise
            sleep(first_wait * 2**k)


class RetryingGenerator:
    """A generator that is asked again once after a transient failure. An attempt runs to its end, so its failure is seen."""

    def __init__(self, generator: Generator, attempts: int = 2, first_wait: float = 1.0):
        self.generator, self.attempts, self.first_wait = generator, attempts, first_wait

    def answer(self, prompts: DataFrame) -> DataFrame:
        return with_retries(lambda: stored(self.generator.answer(prompts), "attempt"), self.attempts, self.first_wait)


# Calls to a provider at a time, retries after the first call, and seconds before the first of them.
CALLS, RETRIES, WAIT = 5, 3, 1.0


def _in_order(call, values: list, attempts: int, wait: float) -> list:
    """``call`` of each value, ``CALLS`` at a time and in the order of the values, with retries."""
    with ThreadPoolExecutor(CALLS) as pool:
        return list(pool.map(lambda v: with_retries(lambda: call(v), attempts, wait), values))


class CallingEmbedder:
    """Vectors from a function of one text, such as a provider's; a vector of another length or with a component that isn't finite is an error."""

    def __init__(self, call: Callable[[str], list[float]], dimension: int, model: str, wait: float = WAIT):
        self.call, self.dimension, self.model, self.wait = call, dimension, model, wait

    def embed(self, text: Column) -> Column:
        call, dimension, wait = self.call, self.dimension, self.wait

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def vectors(texts: pa.Array) -> pa.Array:
            found = [np.asarray(v, np.float32) for v in _in_order(call, [t or "" for t in texts.to_pylist()], 1 + RETRIES, wait)]
            for v in found:
                if v.shape != (dimension,) or not np.isfinite(v).all():
                    raise ValueError(f"an embedding must be one vector of {dimension} finite numbers")
            return pa.array(found, pa.list_(pa.float32()))

        return vectors(text)


ENTITY = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("entity_type", T.StringType())]))
RELATION = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("target", T.StringType()), T.StructField("relation_type", T.StringType()), T.StructField("confidence", T.FloatType())]))
EXTRACTED = T.StructType([T.StructField("entities", ENTITY), T.StructField("relations", RELATION)])


class CallingExtractor:
    """Entities and relations from a function of one text, tried up to three times; a chunk whose tries all fail is skipped.

    An output with more than allowed is no output: it is refused by ``entities.valid_output``, not cut.
    """

    def __init__(self, call: Callable[[str], dict], attempts: int = 3, wait: float = WAIT):
        self.call, self.attempts, self.wait = call, attempts, wait

    def extract(self, chunks: DataFrame) -> DataFrame:
        """``document_id, chunk_id, chunk_index, entities, relations`` of each chunk that has an output."""
        call, attempts, wait, arrow = self.call, self.attempts, self.wait, to_arrow_type(EXTRACTED)

        def tried(text: str) -> dict | None:
            try:
                return with_retries(lambda: call(text), attempts, wait)
            except Exception:  # whatever it is: one chunk's failure is that chunk's alone
                return None

        @F.arrow_udf(EXTRACTED)
        def found(texts: pa.Array) -> pa.Array:
            with ThreadPoolExecutor(CALLS) as pool:
                return pa.array(list(pool.map(tried, [t or "" for t in texts.to_pylist()])), arrow)

        rows = chunks.select("document_id", "chunk_id", "chunk_index", found(F.col("content")).alias("_x"))
        return rows.where("_x is not null").select("document_id", "chunk_id", "chunk_index", "_x.entities", "_x.relations")


# The form that a chat model's answer has to have.
ANSWER_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": list(replies.FIELDS),
    "properties": {"answer": {"type": "string"}, "answer_basis": {"type": "string", "enum": list(replies.BASES)}} | {f: {"type": "array", "items": {"type": "string"}} for f in ("cited_evidence_ids", "notices", "warnings")},
}


class ChatGenerator:
    """Answers of a chat model. ``complete`` sends the body of a request, which is JSON, and gives back the body of the reply; it is called on the executors, some at a time.

    Each reply is read strictly; what is wrong with one is the ``failure`` of its question alone. A call that fails for good ends the step.
    """

    def __init__(self, complete: Callable[[str], str], model: str, temperature: float = 0.0, limits: GroundingLimits | None = None, attempts: int = 1 + RETRIES, wait: float = WAIT):
        if not 0.0 <= temperature <= 2.0:
            raise InvalidSettings("a temperature is from 0 to 2")
        self.complete, self.model, self.temperature, self.limits, self.attempts, self.wait = complete, model, temperature, limits or GroundingLimits(), attempts, wait

    def request(self, prompt: str) -> str:
        """The body of a request for an answer of the one form."""
        form = {"type": "json_schema", "json_schema": {"name": "grounded_answer", "strict": True, "schema": ANSWER_SCHEMA}}
        return json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.limits.output_tokens, "stream": False, "response_format": form})

    def answer(self, prompts: DataFrame) -> DataFrame:
        """``query_id``, the fields of the answer, ``usage`` and ``failure``, the first rule of a reply that is broken, or null."""
        complete, request, attempts, wait = self.complete, self.request, self.attempts, self.wait

        @F.arrow_udf(T.StringType())
        def sent(texts: pa.Array) -> pa.Array:
            return pa.array(_in_order(complete, [request(t or "") for t in texts.to_pylist()], attempts, wait), pa.string())

        bodies = stored(prompts.select("query_id", sent(F.col("prompt")).alias("body")), "replies")
        rows = bodies.select("query_id", replies.parsed(F.col("body"), self.limits).alias("p"))
        return rows.select("query_id", "p.reply.*", "p.usage", "p.failure")


class Preflight:
    """A check that has to pass once before a provider is used. Callers that come together wait for one check; a failure is not remembered."""

    def __init__(self, check: Callable[[], None]):
        self._check, self._lock, self._passed = check, threading.Lock(), False

    def ready(self) -> None:
        with self._lock:
            if not self._passed:
                self._check()
                self._passed = True


class HashEmbedder:
    """Signed hashing of words into a vector of length one; of no words, the first unit vector."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.model = dimension, f"hash-{dimension}"

    def embed(self, text: Column) -> Column:
        dimension = self.dimension

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def vectors(texts: pa.Array) -> pa.Array:
            from zlib import crc32

            out = []
            for t in texts:
                v = np.zeros(dimension, np.float32)
                for w in re.findall(r"\w+", (t.as_py() or "").lower()):
                    h = crc32(w.encode())
                    v[h % dimension] += 1 if h >> 31 else -1
                n = float(np.sqrt((v * v).sum()))
                out.append(v / n if n else np.eye(1, dimension, dtype=np.float32)[0])
            return pa.array(out, pa.list_(pa.float32()))

        return vectors(text)


class SameQuestion:
    """The question as its only variant."""

    def variants(self, questions: DataFrame) -> DataFrame:
        return questions.select("query_id", F.lit(0).alias("variant"), F.col("question").alias("text"))


class FoldedNames:
    """Entities of one folded name are one."""

    def resolve(self, extracted: DataFrame, known: DataFrame) -> DataFrame:
        return entities.resolve(extracted, known)


class KeepOrder:
    def rerank(self, results: DataFrame) -> DataFrame:
        return results


class FirstSentences:
    """The first sentence of each of the first evidence texts, each cited."""

    def __init__(self, blocks: int = 2):
        self.blocks = blocks

    def answer(self, prompts: DataFrame) -> DataFrame:
        """``query_id, answer, cited_evidence_ids, answer_basis, notices, warnings, usage`` from ``query_id, evidence_ids, texts``."""
        n = F.least(F.size("evidence_ids"), F.lit(self.blocks))
        ids, texts = F.slice("evidence_ids", 1, n), F.slice("texts", 1, n)
        part = F.zip_with(texts, ids, lambda t, i: F.concat(F.regexp_extract(t, r"(?s)^[^.!?]{0,200}", 0), F.lit(" "), i))
        nothing = F.array().cast("array<string>")
        return prompts.select(
            "query_id", F.when(n > 0, F.array_join(part, ". ")).otherwise("No evidence was found.").alias("answer"), ids.alias("cited_evidence_ids"),
            F.when(n > 0, "retrieval").otherwise("model_only").alias("answer_basis"), nothing.alias("notices"), nothing.alias("warnings"),
            F.lit(None).cast("struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>").alias("usage"),
        )


def capitalised_names(text: str) -> dict:
    names: list[str] = []
    links = []
    for sentence in re.split(r"[.!?\n]", text):
        own = re.findall(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*", sentence)
        names += [n for n in own if n not in names]
        links += [{"source": a, "target": b, "relation_type": "near", "confidence": 0.5} for a, b in zip(own, own[1:], strict=False)]
    return {"entities": [{"name": n, "entity_type": "name"} for n in names], "relations": links}


class CapitalisedNames(CallingExtractor):
    """Runs of capitalised words as entities, and neighbours within a sentence as relations."""

    def __init__(self):
        super().__init__(capitalised_names, attempts=1)


def check_variants(variants: DataFrame) -> None:
    worst = variants.groupBy("query_id").count().where(~F.col("count").between(1, MAX_VARIANTS)).first()
    if worst:
        raise InvalidQuery(f"query {worst['query_id']} has {worst['count']} variants; 1 to {MAX_VARIANTS} are allowed")
