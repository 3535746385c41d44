"""Links between the items that share a bucket, without emitting pairs.

Rows (bucket, item) are sorted by bucket and numbered as they stream by: an item that is
alone says nothing and is dropped, and every ``block`` items of a bucket are a part. A bucket of one part is
searched as it is; one of more is first cut by a further key that no link crosses, and what is then still large is searched
as pairs of parts over many tasks. Buckets that hold a large
share of all rows are found by a sketch beforehand and dealt into parts by hash, so no task sees
such a bucket whole. A search goes from a first item outwards, against those not reached yet, and only the spanning
links come out: at most one less than the items. No link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.storage import materialise

BLOCK = 8192
#: Buckets that are dealt out by item at most, and entries of the sketch that finds them; a bucket beyond them streams through one task.
HOT, TRACKED = 1000, 16384


def same(left: str, right: str, *names: str) -> Column:
    """The condition that columns of two aliased frames are equal, nulls too."""
    return reduce(and_, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def spanning_links(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of n items; ``near(i, others)`` is a mask."""
    links, left = [], np.arange(n)
    while left.size:
        front, left = [left[0]], left[1:]
        while front and left.size:
            i = front.pop()
            mask = near(i, left)
            if mask.any():
                reached = left[mask]
                links.extend((i, j) for j in reached)
                front.extend(reached)
                left = left[~mask]
    return links


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole runs of equal keys, with where each run starts; the runs are of bounded size."""
    kept: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = [batch.column(k)[0].as_py() for k in keys]
        end = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        kept.append(batch)
        if end == first == last or (last is None and first == end):
            last = end
            continue
        table = pa.Table.from_batches(kept)
        at = starts(table)
        if at[-1]:
            yield table.slice(0, int(at[-1])), at[:-1]
        kept = table.slice(int(at[-1])).combine_chunks().to_batches()
        last = end
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, starts(table)


NUMBERED = "bucket long, item long, part int"


def _numbered(block: int):
    """Distinct items of buckets with two or more, each with its part; of a bucket only the place is remembered."""

    def fn(batches):
        held, last, count = np.empty((2, 0), np.int64), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column("bucket").to_numpy(), batch.column("item").to_numpy()])], axis=1)
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
            if not held.size and last is not None:
                new[0] = (rows[0, 0], rows[1, 0]) != last
            rows = rows[:, new]
            if not rows.size:
                continue
            starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            sizes = np.diff(np.append(starts, rows.shape[1]))
            before = np.zeros(starts.size, np.int64)
            if last is not None and rows[0, 0] == last[0]:
                before[0] = count
            total = before + sizes
            place = np.arange(rows.shape[1]) + np.repeat(before - starts, sizes)
            out = np.repeat(total >= 2, sizes)
            last = (rows[0, -1], rows[1, -1])
            held, count = (rows[:, -1:], 0) if total[-1] == 1 else (held[:, :0], int(total[-1]))
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[0, out]), pa.array(rows[1, out]), pa.array((place[out] // block).astype(np.int32))], names=["bucket", "item", "part"])

    return fn


def candidates(spark: SparkSession, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Items of buckets with two different items or more, stored: ``bucket, item, part``.

    ``rows``: ``bucket`` and ``item`` (long, not null), repeats allowed. A part has about ``block`` items at most.
    """
    rows = rows.select("bucket", "item")
    top = rows.agg(F.expr(f"approx_top_k(bucket, {HOT}, {TRACKED})").alias("top")).first().top or []
    hot = [x["item"] for x in top if x["count"] > block]
    cold = rows.where(~F.col("bucket").isin(hot)) if hot else rows
    numbered = cold.repartition("bucket").sortWithinPartitions("bucket", "item").mapInArrow(_numbered(block), NUMBERED)
    if hot:
        own = materialise(spark, rows.where(F.col("bucket").isin(hot)).distinct(), "hot")
        sizes = own.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).alias("parts"))
        dealt = own.join(F.broadcast(sizes), "bucket")  # at most HOT rows
        numbered = numbered.unionByName(dealt.select("bucket", "item", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int").alias("part")))
    return materialise(spark, numbered, "buckets")


def paired(spark: SparkSession, found: DataFrame, block: int = BLOCK, cut: Callable[[DataFrame], DataFrame] | None = None, cut_from: int = 1) -> DataFrame:
    """The rows of ``candidates`` once for every pair of parts that an item is in: ``bucket, item, i, j``.

    A task of ``linked`` takes one bucket, i, j, which has no more than about two parts. ``cut`` makes buckets of more than ``cut_from`` parts into smaller ones
    (``bucket, item``), of which any two items that link share one; what is then still large is paired by parts. Pairing copies an item once
    for each other part, and cutting once for each of its new buckets, so ``cut_from`` is how many those are, about.
    """
    large = found.where("part > 0").groupBy("bucket").agg((F.max("part") + 1).alias("parts"))
    if cut is not None:
        large = materialise(spark, large.where(F.col("parts") > cut_from), "large")
        small = paired(spark, found.join(large, "bucket", "left_anti"), block)
        if large.isEmpty():
            return small
        return small.unionByName(paired(spark, candidates(spark, cut(found.join(large.select("bucket"), "bucket").select("bucket", "item")), block), block))
    other = F.explode(F.when(F.col("parts").isNull(), F.array("part")).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part")))).alias("other")
    pairs = found.join(large, "bucket", "left").select("bucket", "item", "part", other)
    return pairs.select("bucket", "item", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))


def by_rare_shingles(spark: SparkSession, sets: DataFrame, similar: float) -> Callable[[DataFrame], DataFrame]:
    """Cuts buckets of sets (``item, shingles``) by their rare members.

    With the members of each set in the order of how many sets of the bucket have them, two sets of a Jaccard similarity of
    ``similar`` or more have a common one among the first n - ceil(similar n) + 1 of each; those are the new buckets.
    """

    def cut(rows: DataFrame) -> DataFrame:
        flat = materialise(spark, rows.join(sets, "item").select("bucket", "item", F.size("shingles").alias("n"), F.explode("shingles").alias("s")), "members")
        counts = flat.groupBy("bucket", "s").agg(F.count("*").alias("c"))
        listed = flat.join(counts, ["bucket", "s"]).groupBy("bucket", "item", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all"))
        first = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * similar - 1e-9).cast("int") + 1)
        return listed.select("bucket", "item", F.explode(first).alias("x")).select(F.xxhash64("bucket", "x.s").alias("bucket"), "item")

    return cut


def linked(found: DataFrame, near_in: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """Spanning links ``a, b`` within each bucket, i, j of ``paired``.

    ``near_in(table)`` gets the rows of one task's bucket and returns the
    ``near`` of ``spanning_links``.
    """
    keys = ["bucket", "i", "j"]

    def fn(batches):
        for table, at in _runs(batches, keys):
            item, a, b = table.column("item").to_numpy(), [], []
            for s, e in zip(at, np.append(at[1:], table.num_rows), strict=True):
                links = spanning_links(int(e - s), near_in(table.slice(int(s), int(e - s))))
                a.extend(item[s + x] for x, _ in links)
                b.extend(item[s + y] for _, y in links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return found.repartition(*keys).sortWithinPartitions(*keys, "item").mapInArrow(fn, "a long, b long")
