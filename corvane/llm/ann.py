"""Nearest neighbours by collision-counting hashing.

Vectors of length one are projected on random directions; each projection is
an array sorted by value. A query opens a window around its own value in every array and widens all of
them together (virtual rehashing). A vector that falls into a window collides once
for that array; the ones that collide often enough are verified with their exact cosine.
The windows widen until their radius reaches the distance of the last neighbour wanted: one that is as near
has then collided often enough with a probability of about 0.93, nearer ones more surely.

Vectors are dealt out by hash into blocks of bounded size, and the queries into
chunks; a task holds one block, its arrays and one chunk of queries. Equal vectors
are one vector with its smallest ids, as many as an answer can use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.storage import materialise

#: Vectors in a block and queries in a chunk, on average.
BLOCK, CHUNK = 16384, 4096
#: Arrays, and the collisions from which a vector is verified, as a share of them.
ARRAYS, COLLIDE = 128, 0.6
#: Radii (lengths are 1): the first, and the most and the least growth from one to the next.
RADIUS, GROWTH, STEP = 0.1, 1.3, 1.02
#: Half the width of a window over the radius; a vector at the radius collides with probability 0.66.
HALF_WIDTH = 0.95
#: Queries whose collision counts are held at a time.
TOGETHER = 128


def directions(dim: int, arrays: int = ARRAYS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, arrays))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that their largest components are near 1: squares neither vanish nor overflow, and no cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


class Block:
    """Sorted arrays of one block's vectors."""

    def __init__(self, vectors: np.ndarray, arrays: int = ARRAYS):
        self.vectors = vectors = scaled(vectors)
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.axes = directions(vectors.shape[1], arrays)
        values = (vectors / self.norms[:, None]) @ self.axes
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.sort(values, axis=0).T)

    def cosines(self, query: np.ndarray, which: np.ndarray) -> np.ndarray:
        dots = (self.vectors[which] * query).sum(1)
        return dots / (self.norms[which] * np.sqrt((query * query).sum()))

    def search(self, queries: np.ndarray, k: int, collide: float = COLLIDE) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and cosines of all verified vectors, at least ``k`` if there are as many."""
        n, arrays = self.vectors.shape[0], self.values.shape[0]
        queries = scaled(queries)
        k, need = min(n, k), int(np.ceil(collide * arrays))
        at = np.ascontiguousarray(((queries / np.sqrt((queries * queries).sum(1))[:, None]) @ self.axes).T)
        counts, done = np.zeros((len(queries), n), np.uint8 if arrays < 256 else np.int32), np.zeros((len(queries), n), bool)
        radius, last = np.full(len(queries), RADIUS), np.full(len(queries), np.inf)
        low = np.stack([np.searchsorted(v, x, "left") for v, x in zip(self.values, at, strict=True)], axis=1)
        high, open_ = low.copy(), np.arange(len(queries))
        found: list[tuple[list, list]] = [([], []) for _ in queries]
        while open_.size:
            reach = HALF_WIDTH * radius[open_]
            left = np.stack([np.searchsorted(v, x[open_] - reach, "left") for v, x in zip(self.values, at, strict=True)], axis=1)
            right = np.stack([np.searchsorted(v, x[open_] + reach, "right") for v, x in zip(self.values, at, strict=True)], axis=1)
            for i, q in enumerate(open_.tolist()):
                bounds = zip(left[i].tolist(), low[q].tolist(), high[q].tolist(), right[i].tolist(), strict=True)
                opened = [part for row, (a, b, c, d) in zip(self.order, bounds, strict=True) for part in (row[a:b], row[c:d])]
                counts[q] += np.bincount(np.concatenate(opened), minlength=n).astype(counts.dtype)
                new = np.flatnonzero((counts[q] >= need) & ~done[q])
                done[q, new] = True
                found[q][0].append(new)
                found[q][1].append(self.cosines(queries[q], new))
                cosines = np.concatenate(found[q][1])
                if cosines.size >= k:
                    last[q] = np.sqrt(max(0.0, 2 - 2 * np.partition(cosines, cosines.size - k)[cosines.size - k]))
            low[open_], high[open_] = left, right
            open_ = open_[(last[open_] > radius[open_]) & ~done[open_].all(1)]
            radius[open_] = np.minimum(radius[open_] * GROWTH, np.maximum(radius[open_] * STEP, last[open_]))
        return [(np.concatenate(places), np.concatenate(cosines)) for places, cosines in found]


def _search(k: int, keep: int):
    schema = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])

    def fn(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if data.num_rows and queries.num_rows:
            stack = lambda t: np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1)
            block, ids = Block(stack(data)), data.column("ids").to_pylist()
            asked, vectors = queries.column("query_id").to_pylist(), stack(queries)
            first = np.array([x[0] for x in ids])
            for s in range(0, len(asked), TOGETHER):
                # one more than k: the query's own vector may be among them
                for q, (places, scores) in zip(asked[s : s + TOGETHER], block.search(vectors[s : s + TOGETHER], keep), strict=True):
                    for at in np.lexsort((first[places], -scores))[:keep]:
                        out[0].append(q)
                        out[1].append(ids[places[at]])
                        out[2].append(float(scores[at]))
        return pa.table([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return fn


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that are neither null, empty or zero nor hold null or non-finite components."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found for each query.

    ``vectors``: ``vec_id`` (long), ``v`` (array of numbers); ``queries`` likewise, its ids a
    part of theirs or others. Score: the cosine of the original vectors in double precision; ties go to the
    smaller id, and a row never answers its own id. Vectors that are null, empty, zero or hold null
    or non-finite components take no part on either side, and only vectors of equal length are compared. If there
    are fewer candidates, all are returned. Rows with a null id take no part; an id in several rows
    counts as several vectors and is asked once. Other columns are not looked at. Empty tables give no rows.
    """
    keep = k + 1
    typed = lambda df, name: usable(df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias(name), F.col("v").cast("array<double>").alias("v")))
    ranks = Window.partitionBy("v").orderBy("vec_id")
    # of equal vectors the k + 1 smallest ids can be answers; the limit is applied before the shuffle, too
    copies = typed(vectors, "vec_id").withColumn("_n", F.row_number().over(ranks)).where(F.col("_n") <= keep)
    distinct = materialise(spark, copies.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    asked = typed(queries, "query_id").dropDuplicates(["query_id"])
    n, m = distinct.count(), asked.count()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-m // chunk))
    deal = lambda col, parts: F.pmod(F.xxhash64(F.lit("deal"), col), F.lit(parts)).cast("int")
    dim = F.size("v").alias("dim")
    data = distinct.select(dim, deal("v", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "v", "ids")
    ask = asked.select(dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal("query_id", chunks).alias("chunk"), "v", "query_id")
    keys = ["dim", "block", "chunk"]
    local = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(_search(k, keep), "query_id long, ids array<long>, score double")
    flat = local.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
