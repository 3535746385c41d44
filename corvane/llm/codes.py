"""Short codes of vectors: one byte for each of several equal parts, by exact integer k-means.

Components become integers, and the parts of all vectors are grouped: equal parts of a position are one row with a weight. Lloyd's rounds run over
these distinct rows, whose sums of weighted components come back as one small row an entry. The final codes and errors
of the distinct rows are then joined back to the vectors. All arithmetic is in integers, so neither the order of rows nor their partitions matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.storage import discard, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: A key with more than one of so many rows is joined by broadcast: there are no more such keys than this.
SHARES = 1000


class Codebooks(NamedTuple):
    """``entries[part]``: an integer matrix, one row an entry."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for row in e.tolist() for x in row).encode()).hexdigest()


def usable(v: Column) -> Column:
    """Whether a vector is there, with no null or non-finite component."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def nearest(book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry nearest to each part, the first of equals, and its squared distance."""
    best, at = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    for k, entry in enumerate(book):
        d = parts - entry
        d = np.einsum("ij,ij->i", d, d)
        closer = d < best
        best[closer], at[closer] = d[closer], k
    return at, best


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = batch.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)
    return batch.column("pos").to_numpy(), parts, batch.column("weight").to_numpy()


def _sums(distinct: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """The weight and the weighted sum of what each entry is nearest to, one row an entry and task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros((len(e), width), np.int64) for e in books.entries]
        for batch in batches:
            pos, parts, weight = _columns(batch, width)
            for p in np.unique(pos):
                own, w = parts[pos == p], weight[pos == p]
                at, _ = nearest(books.entries[p], own)
                np.add.at(count[p], at, w)
                np.add.at(total[p], at, own * w[:, None])
        rows = [(p, k, int(n), total[p][k].tolist()) for p, c in enumerate(count) for k, n in enumerate(c) if n]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["pos", "entry", "weight", "total"])

    found = distinct.mapInArrow(summed, "pos int, entry int, weight long, total array<long>")
    return found.groupBy("pos", "entry").agg(F.sum("weight").alias("weight"), *[F.sum(F.col("total")[j]).alias(f"c{j}") for j in range(width)])


def lloyd(distinct: DataFrame, first: Codebooks, width: int, rounds: int = ROUNDS) -> Codebooks:
    """Rounds of assignment and componentwise floored means over weighted distinct parts; an entry that nothing is nearest to stays."""
    books = first
    for _ in range(rounds):
        entries = [e.copy() for e in books.entries]
        for r in _sums(distinct, books, width).collect():  # a row an entry at most
            entries[r["pos"]][r["entry"]] = [r[f"c{j}"] // r["weight"] for j in range(width)]
        books = Codebooks(entries)
    return books


def assigned(distinct: DataFrame, books: Codebooks, width: int) -> DataFrame:
    """The distinct parts with the ``entry`` nearest to each and the squared distance ``error``."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, parts, _ = _columns(batch, width)
            entry, error = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                entry[pos == p], error[pos == p] = nearest(books.entries[p], parts[pos == p])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("weight"), pa.array(entry), pa.array(error)], ["pos", "part", "weight", "entry", "error"])

    return distinct.mapInArrow(coded, "pos int, part array<int>, weight long, entry int, error long")


def joined_by_share(rows: DataFrame, values: DataFrame, keys: list[str], total: int, shares: int = SHARES) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a key and its number of rows as ``weight``; nulls are equal.

    Keys with more than one of ``shares`` rows are few, and broadcast; no task of the shuffled join gets such a key.
    """
    values = values.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in values.columns if c not in keys])

    def same(other: DataFrame) -> Column:
        out = F.lit(True)
        for k in keys:
            out &= rows[k].eqNullSafe(other[f"_{k}"])
        return out

    often = F.broadcast(values.where(F.col("weight") * shares > total).drop("weight"))
    rest = values.where(F.col("weight") * shares <= total).drop("weight")
    names = [f"_{k}" for k in keys]
    few = often.select(names)
    return rows.join(often, same(often)).drop(*names).unionByName(rows.join(few, same(few), "left_anti").join(rest, same(rest)).drop(*names))


def compress(spark: SparkSession, vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Codes of ``vectors`` (``vec_id, label, v``) and the codebooks: ``vec_id, label, code array<int>, error, label_error``.

    Vectors that are null or hold null or non-finite components have no row. A component x is floor(scale * x). The first codebooks
    are the parts of the ``entries`` smallest ids, nulls last, each id once with its smallest vector; fewer ids give smaller codebooks.
    Repeated rows count and come back as often as they are there. An empty table gives no rows. Vectors of
    different lengths, a length that ``parts`` doesn't divide, and integers whose squared distances a long can't hold are errors.
    """
    ints = F.transform("v", lambda x: F.floor(x.cast("double") * float(scale)).try_cast("int"))
    kept = materialise(spark, vectors.where(usable(F.col("v"))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("v")), "code-vectors")
    most = F.max(F.greatest(F.abs(F.array_max("v").cast("long")), F.abs(F.array_min("v").cast("long")), F.lit(0)))
    facts = kept.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), most.alias("most"), F.bool_or(F.exists("v", F.isnull)).alias("over")).first()
    n, size = facts["n"], facts["low"] or 0
    if size != (facts["high"] or 0) or size % parts:
        raise ValueError(f"vectors of {facts['low']} to {facts['high']} components don't fall into {parts} equal parts")
    if facts["over"] or (size and facts["most"] > isqrt((2**63 - 1) // (4 * size))):
        raise ValueError("vectors are too long for exact squared distances")
    width = size // parts
    part = F.slice("v", F.col("pos") * width + 1, F.lit(width))
    exploded = kept.select("row", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("pos"), "v", "vec_id", "label")
    exploded = exploded.select("row", "pos", part.alias("part"), F.when(F.col("pos") == 0, F.struct("vec_id", "label")).alias("head"))
    distinct = materialise(spark, exploded.groupBy("pos", "part").agg(F.count("*").alias("weight")), "code-parts")

    ids = kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    chosen = kept.join(F.broadcast(ids.withColumnRenamed("vec_id", "_id")), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    first = [r["v"] for r in chosen.orderBy(F.col("vec_id").asc_nulls_last()).collect()]
    start = np.array(first, np.int64).reshape(len(first), size)
    books = lloyd(distinct, Codebooks([start[:, p * width : (p + 1) * width] for p in range(parts)]), width, rounds if n else 0)

    coded = joined_by_share(exploded, assigned(distinct, books, width), ["pos", "part"], n)
    whole = coded.groupBy("row").agg(F.first("head", ignorenulls=True).alias("head"), F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("codes"), F.sum("error").alias("error"))
    found = materialise(spark, whole.select("head.vec_id", "head.label", F.col("codes.entry").alias("code"), "error"), "code-rows")
    discard(spark, kept, distinct)
    labels = found.groupBy("label").agg(F.count("*").alias("weight"), F.sum("error").alias("label_error"))
    return joined_by_share(found, labels, ["label"], n), books
