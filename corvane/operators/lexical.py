"""Fielded BM25 over chunks, for many queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.errors import IndexBuildError
from corvane.functions.analyze import plain_terms
from corvane.functions.text import trimmed
from corvane.settings import Bm25Settings, Filters
from corvane.sources.shared import stored

FIELDS = ("content", "title", "section_path")
KEY = ("document_id", "chunk_index", "chunk_id")
#: Decimals of a score that is a sum over shuffled rows: what its order can't change.
DECIMALS = 9
#: Terms of all queries up to which a search sends them to the scan and scores chunks there; more are joined.
NAMED_TERMS = 1 << 14
#: Scores that a task has at a time.
SCORES_TOGETHER = 1 << 20


def matches(filters: Filters, fold: bool = True) -> Column:
    """Rows that the filters let pass; a null content type matches no filter on it. Lexical search folds the type's case, dense search doesn't."""
    ok = F.lit(True)
    if filters.document_ids:
        ok = ok & F.col("document_id").isin(*filters.document_ids)
    if filters.content_types:
        ok = ok & F.coalesce((F.lower("content_type") if fold else F.col("content_type")).isin(*filters.content_types), F.lit(False))
    return ok


def check_rows(chunks: DataFrame) -> None:
    """An error that names the first row with a blank required field."""
    for name in ("document_id", "chunk_id", "content"):
        blank = F.coalesce(F.length(trimmed(F.col(name).cast("string"))) == 0, F.lit(True))
        row = chunks.where(blank).orderBy("document_id", "chunk_index").select("document_id", "chunk_index").first()
        if row:
            raise IndexBuildError(tuple(row), name, "blank")


def tokens(chunks: DataFrame, analyzer: Callable[[Column], Column] = plain_terms, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The chunks' keys with one array of terms a field; a null field has none."""
    return chunks.select(*KEY, *[analyzer(F.col(f)).alias(f) for f in fields])


def statistics(tok: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row: ``n`` chunks and the average length ``avg_<field>`` of each field, at least 1; blank fields count."""
    n = F.greatest(F.count("*"), F.lit(1))
    return tok.agg(F.count("*").alias("n"), *[F.greatest(F.lit(1.0), F.sum(F.size(f)) / n).alias(f"avg_{f}") for f in fields])


def _counted(field: str) -> Column:
    """The distinct terms of a sorted field with how often each stands in it: where a run of equal terms starts, and where the next one does."""
    at = f"_at_{field}"
    ends = lambda x, k: F.coalesce(F.get(at, k + 1), F.size(field)) - x
    return F.transform(at, lambda x, k: F.struct(F.lit(field).alias("field"), F.size(field).alias("length"), F.get(field, x).alias("term"), ends(x, k).cast("long").alias("tf")))


def _starts(field: str) -> Column:
    every = F.when(F.size(field) > 0, F.sequence(F.lit(0), F.size(field) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda k: (k == 0) | (F.get(field, k) != F.get(field, k - 1)))


def postings(tok: DataFrame, fields: tuple[str, ...] = FIELDS, wanted: DataFrame | None = None) -> DataFrame:
    """``term, field, tf, length`` by chunk: how often a term is in a field of so many terms.

    A chunk's terms are counted where it is read. Only chunks whose key stands in several rows are added up by a shuffle, as fields of one length are one.
    With ``wanted`` (``term``) only those terms.
    """
    ordered = tok.select(*KEY, *[F.sort_array(f).alias(f) for f in fields])
    flat = ordered.select("*", *[_starts(f).alias(f"_at_{f}") for f in fields]).select(*KEY, F.explode(F.concat(*map(_counted, fields))).alias("_p")).select(*KEY, "_p.*")
    columns = [*KEY, "field", "length", "term"]
    if wanted is not None:
        return flat.join(wanted, "term", "left_semi").groupBy(*columns).agg(F.sum("tf").alias("tf"))
    repeated = stored(tok.groupBy(*KEY).count().where("count > 1").select(*KEY), "repeated-keys")
    if repeated.isEmpty():
        return flat.select(*columns, "tf")
    same = reduce(Column.__and__, [flat[k].eqNullSafe(repeated[k]) for k in KEY])
    several = flat.join(repeated, same, "left_semi").groupBy(*columns).agg(F.sum("tf").alias("tf"))
    return flat.join(repeated, same, "left_anti").select(*columns, "tf").unionByName(several)


def document_frequency(post: DataFrame) -> DataFrame:
    """Chunks that hold a term in any field."""
    return post.groupBy("term").agg(F.countDistinct("chunk_id").alias("df"))


def _weights(s: Bm25Settings) -> dict[str, float]:
    return {"content": s.content_boost, "title": s.title_boost, "section_path": s.section_boost}


def scored(chunks: DataFrame, queries: DataFrame, settings: Bm25Settings | None = None, analyzer=plain_terms, fields: tuple[str, ...] = FIELDS, limit: int | None = None, filters: Filters | None = None) -> DataFrame:
    """``query_id``, the chunk's keys and ``score`` of every chunk above 0 that the filters let pass.

    ``queries``: ``query_id, text``; a query's terms are a set. The chunks are cut into terms once: what is kept of each are its lengths and
    those of its terms that some query has, so it is scored where that is read. With ``limit`` a task leaves out what can't be among
    the best so many of a query. Chunks that share an id, and queries of more than ``NAMED_TERMS`` terms, are scored by joins.
    """
    s = settings or Bm25Settings()
    filtered = filters if filters and (filters.document_ids or filters.content_types) else None
    each = queries.select("query_id", F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term"))
    asked = stored(each.groupBy("query_id").agg(F.collect_list("term").alias("terms")).withColumn("_q", F.monotonically_increasing_id()), "asked")
    if (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) > NAMED_TERMS:
        return _joined(chunks, queries, s, analyzer, fields, filtered)
    wanted = {r["_q"]: r["terms"] for r in asked.select("_q", "terms").collect()}
    terms = sorted({t for x in wanted.values() for t in x})
    passes = matches(filtered) if filtered else F.lit(True)
    tok = chunks.select(*KEY, passes.alias("_passes"), *[analyzer(F.col(f)).alias(f) for f in fields])
    named = lambda f: F.filter(f, lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    rows = stored(tok.select(*KEY, "_passes", *[F.size(f).alias(f"_n_{f}") for f in fields], *[named(f).alias(f) for f in fields]), "asked-terms")
    if not rows.groupBy("chunk_id").count().where("count > 1 or chunk_id is null").isEmpty():
        return _joined(chunks, queries, s, analyzer, fields, filtered)
    n = F.greatest(F.count("*"), F.lit(1))
    stats = rows.agg(F.count("*").alias("n"), *[F.greatest(F.lit(1.0), F.sum(f"_n_{f}") / n).alias(f) for f in fields]).first()
    df = {r["term"]: r["df"] for r in rows.select(F.explode(F.array_distinct(F.concat(*fields))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = np.array([np.log1p((stats["n"] - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in terms])
    schema = T.StructType([T.StructField("_q", T.LongType()), *[rows.schema[k] for k in KEY], T.StructField("score", T.DoubleType())])
    found = rows.where("_passes").mapInArrow(_scan(terms, idf, wanted, s, {f: stats[f] for f in fields}, limit, to_arrow_schema(schema)), schema)
    found = found.join(F.broadcast(asked.select("_q", "query_id")), "_q").select("query_id", *KEY, F.round("score", DECIMALS).alias("score"))
    return found.where("score > 0")


def _scan(terms: list[str], idf: np.ndarray, wanted: dict[int, list[str]], s: Bm25Settings, average: dict[str, float], limit: int | None, schema: pa.Schema):
    """Scores of the chunks of a batch from their asked terms, to which the queries of each term are listed."""
    numbers, place = np.array(sorted(wanted), np.int64), {t: k for k, t in enumerate(terms)}
    pairs = sorted((place[t], k) for k, q in enumerate(sorted(wanted)) for t in wanted[q])
    of, by = np.array([t for t, _ in pairs], np.int64), np.array([k for _, k in pairs], np.int64)
    first = np.searchsorted(of, np.arange(len(terms) + 1))
    boosts, k1, b = _weights(s), s.k1, s.b

    def scores(batch: pa.RecordBatch, known: pa.Array) -> np.ndarray:
        total = np.zeros((batch.num_rows, numbers.size))
        for f, mean in average.items():
            lists = batch.column(f)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            found, tf = np.unique(row * len(terms) + pc.index_in(lists.flatten(), known).to_numpy(), return_counts=True)
            row, term = found // max(1, len(terms)), found % max(1, len(terms))
            length = batch.column(f"_n_{f}").to_numpy()[row]
            value = boosts[f] * idf[term] * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))
            times = first[term + 1] - first[term]
            query = by[np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
            total += np.bincount(np.repeat(row, times) * numbers.size + query, np.repeat(value, times), total.size).reshape(total.shape)
        return total

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size = pa.array(terms, pa.string()), max(1, SCORES_TOGETHER // max(1, numbers.size))
        best = np.zeros((limit or 0, numbers.size))
        for batch in (x.slice(k, size) for x in batches for k in range(0, x.num_rows, size)):
            if not numbers.size:
                continue
            total = scores(batch, known)
            floor = np.zeros(numbers.size)
            if limit:
                best = np.sort(np.concatenate([best, total]), 0)[-limit:]
                floor = best[0] - 2 * 10.0**-DECIMALS  # scores that may be equal when rounded
            row, query = np.nonzero((total > 0) & (total >= floor))
            keys = batch.select(list(KEY)).take(pa.array(row))
            columns = [pa.array(numbers[query]), *keys.columns, pa.array(total[row, query])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return fn


def _joined(chunks: DataFrame, queries: DataFrame, s: Bm25Settings, analyzer, fields: tuple[str, ...], filters: Filters | None) -> DataFrame:
    """Scores by joins, for any number of terms and rows that share an id. Only terms of some query leave the scan: they are filtered
    before the first shuffle, while lengths and the number of chunks come from all."""
    boosts = _weights(s)
    tok = tokens(chunks, analyzer, fields)
    asked = queries.select("query_id", F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term"))
    # two passes over the chunks: one for their postings of these terms, which are few, and one for lengths
    post = stored(postings(tok, fields, asked.select("term").distinct()), "postings")
    rows = post.join(document_frequency(post), "term").join(asked, "term").join(F.broadcast(statistics(tok, fields)))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost, average = F.lit(0.0), F.lit(1.0)
    for f in fields:
        boost = F.when(F.col("field") == f, F.lit(float(boosts[f]))).otherwise(boost)
        average = F.when(F.col("field") == f, F.col(f"avg_{f}")).otherwise(average)
    value = boost * idf * (F.col("tf") * (s.k1 + 1)) / (F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("length") / average))
    found = rows.groupBy("query_id", *KEY).agg(F.round(F.sum(value), DECIMALS).alias("score")).where("score > 0")
    return stored(found, "scores").join(chunks.where(matches(filters)).select("chunk_id"), "chunk_id", "left_semi") if filters else found


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` of each query with their rank; ties by document, index and chunk."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def search(chunks: DataFrame, queries: DataFrame, limit: int, filters: Filters | None = None, settings: Bm25Settings | None = None, analyzer=plain_terms, fields=FIELDS) -> DataFrame:
    """Top chunks of each query. Filters act on the rows alone, never on the statistics."""
    return top(scored(chunks, queries, settings, analyzer, fields, limit, filters), limit)
