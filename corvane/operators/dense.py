"""Exact nearest chunks by squared distance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.errors import IndexBuildError, InvalidSettings
from corvane.functions.text import trimmed
from corvane.operators.lexical import DECIMALS, KEY, matches
from corvane.settings import Filters


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in double precision, from left to right; null if the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def dense_score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(distance, F.lit(0.0)))


def query_vector(values: list[float]) -> Column:
    """A literal vector; an empty one or one with a component that isn't finite is an error."""
    if not values or not all(math.isfinite(v) for v in values):
        raise InvalidSettings("a query vector must be finite and not empty")
    return F.array(*[F.lit(float(v)) for v in values])


#: Bytes of query vectors that meet the chunks in one pass: 60,000 of 64 components.
TOGETHER = 32 << 20
#: Rows that leave a task together.
ROWS_TOGETHER = 1 << 16
#: Queries that meet a batch of chunks in one product of matrices, and the squared length from which on a vector (or one that isn't finite) is compared by differences alone.
QUERIES_TOGETHER, MOST_SQUARE = 64, 1e200


def _pairs(vectors: np.ndarray, ids: list, id_type: pa.DataType, best: int | None):
    """For each batch of chunks its keys, query and squared distance, for the ``best`` chunks of a query in the batch and those that tie with the last."""

    norms = np.square(vectors).sum(1)

    def candidates(own):
        """For each query the rows that may be among its ``best``: by products of matrices, with what these may be off."""
        size = np.square(own).sum(1)
        usual = np.flatnonzero(size < MOST_SQUARE)
        odd, some_own, size = np.flatnonzero(~(size < MOST_SQUARE)), own[usual], size[usual]
        for k in range(0, len(vectors), QUERIES_TOGETHER):
            some, length = vectors[k : k + QUERIES_TOGETHER], norms[k : k + QUERIES_TOGETHER]
            if best is None or best >= usual.size or not (length < MOST_SQUARE).all():
                yield from (np.arange(len(own)) for _ in some)
                continue
            near = size - 2.0 * (some @ some_own.T) + length[:, None]
            off = 8 * (vectors.shape[1] + 8) * np.finfo(np.float64).eps * (size.max() + length)
            last = np.partition(near, best - 1, axis=1)[:, best - 1]
            inside = near <= (last + off + 2 * 10.0 ** -DECIMALS)[:, None]
            yield from (np.sort(np.append(usual[row], odd)) if odd.size else usual[row] for row in inside)

    def fn(batches):
        for batch in batches:
            lists = batch.column("embedding")
            fits = np.flatnonzero(np.array(lists.value_lengths().fill_null(-1)) == vectors.shape[1])
            own = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(fits.size, vectors.shape[1])
            out, n = [], 0
            for q, near in enumerate(candidates(own) if fits.size else ()):
                d = np.square(own[near] - vectors[q]).sum(1)
                if best is not None and best < d.size:
                    kept = ~(d > np.partition(d, best - 1)[best - 1] + 10.0 ** -DECIMALS)
                    near, d = near[kept], d[kept]
                out.append((np.full(near.size, q), fits[near], d))
                n += near.size
                if n >= ROWS_TOGETHER:
                    yield made(batch, out)
                    out, n = [], 0
            if out:
                yield made(batch, out)

    asked = pa.array(ids, id_type)

    def made(batch, out):
        q, at, d = (np.concatenate(x) for x in zip(*out, strict=True))
        names = [k for k in batch.schema.names if k != "embedding"]
        keys = [batch.column(k).take(pa.array(at)) for k in names]
        return pa.RecordBatch.from_arrays([asked.take(pa.array(q)), *keys, pa.array(d)], names=["query_id", *names, "distance"])

    return fn


def distances(rows: DataFrame, queries: DataFrame, keys: tuple[str, ...], best: int | None = None) -> DataFrame:
    """``query_id``, the keys and ``distance`` of chunks to the queries of as long a vector; with ``best`` a superset of so many nearest ones.

    ``queries`` (``query_id, vector``) is a stated set; it goes out in parts of ``TOGETHER`` bytes, each of which takes one pass over ``rows``.
    """
    kind = queries.schema["query_id"].dataType
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    size = asked.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0)).alias("n")).first()["n"]
    # parts by a hash, so no task sees all queries; twice as many as their sizes ask for, as they differ
    parts = 1 if size <= TOGETHER else 2 * -(-size // TOGETHER)
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    schema = T.StructType([T.StructField("query_id", kind), *[rows.schema[k] for k in keys], T.StructField("distance", T.DoubleType())])
    out = rows.sparkSession.createDataFrame([], schema)
    for k in range(parts):
        here = asked.where(F.col("_part") == k).collect()
        for dim in sorted({len(r["vector"]) for r in here}):
            own = [r for r in here if len(r["vector"]) == dim]
            fn = _pairs(np.array([r["vector"] for r in own], np.float64), [r["query_id"] for r in own], to_arrow_type(kind), best)
            out = out.unionByName(rows.select(*keys, "embedding").mapInArrow(fn, schema))
    return out


def search(chunks: DataFrame, queries: DataFrame, limit: int, filters: Filters | None = None, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The nearest ``limit`` chunks of each query, filtered before the limit.

    ``chunks``: keys and ``embedding``; ``queries``: ``query_id, vector``, a stated set that meets all chunks.
    Returns ``query_id``, the keys, ``distance``, ``score`` and ``rank``; ties by key. Of each batch of chunks only the nearest leave the task.
    """
    rows = chunks.where(matches(filters, fold=False)) if filters else chunks
    found = distances(rows, queries, keys, limit).withColumn("distance", F.round("distance", DECIMALS))
    found = found.withColumn("score", dense_score(F.col("distance")))
    order = Window.partitionBy("query_id").orderBy("distance", *keys)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def check_rows(found: DataFrame) -> None:
    """An error that names the first result with a blank key or a distance that isn't finite."""
    for name in ("document_id", "chunk_id"):
        row = found.where(F.coalesce(F.length(trimmed(F.col(name))) == 0, F.lit(True))).first()
        if row:
            raise IndexBuildError(row["chunk_id"], name, "blank")
    bad = F.col("distance").isNull() | F.isnan("distance") | (F.abs("distance") == float("inf"))
    row = found.where(bad).first()
    if row:
        raise IndexBuildError(row["chunk_id"], "distance", "not finite")
