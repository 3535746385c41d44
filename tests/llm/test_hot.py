"""Buckets of any size: no pair is lost and no task holds one whole."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import blocking, decontam, simhash


def groups(rows):
    out: dict = {}
    for r in rows:
        out.setdefault((r.bucket, r.i, r.j), set()).add(r.item)
    return out


@pytest.mark.parametrize("block", [3, 8, 50, 10_000])
def test_every_pair_of_a_bucket_meets(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([1, 1, 1, 2, 3, rng.randrange(200)]), rng.randrange(120)) for _ in range(600)] + [(999, 5)] * 50
    want = {}
    for b, i in rows:
        want.setdefault(b, set()).add(i)
    found = blocking.candidates(spark, spark.createDataFrame(rows, "bucket long, item long"), block)
    got = groups(blocking.paired(spark, found, block).collect())
    met = {(b, *sorted(p)) for (b, _, _), items in got.items() for p in combinations(items, 2)}
    assert met == {(b, *sorted(p)) for b, items in want.items() for p in combinations(items, 2)}
    assert {b for b, _, _ in got} == {b for b, items in want.items() if len(items) > 1}
    assert blocking.candidates(spark, spark.createDataFrame([], "bucket long, item long"), block).count() == 0


def test_a_hot_bucket_is_dealt_out(spark):
    rows = spark.range(200_000).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("item")).union(spark.range(60_000).selectExpr("id div 2", "id"))
    sizes = blocking.paired(spark, blocking.candidates(spark, rows, 20_000), 20_000).groupBy("bucket", "i", "j").count().where("bucket = 7").collect()
    assert len(sizes) == 45 and max(r["count"] for r in sizes) < 1.1 * 40_000


def cut_pairs(spark, rows, block, cut):
    found = blocking.candidates(spark, spark.createDataFrame(rows, "bucket long, item long"), block)
    got = groups(blocking.paired(spark, found, block, cut).collect())
    return {tuple(sorted(p)) for items in got.values() for p in combinations(items, 2)}


def test_a_cut_by_bits_loses_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    flipped = lambda n: centre ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = sorted({flipped(rng.randrange(1, 9)) for _ in range(300)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    met = cut_pairs(spark, [(1, p) for p in signed], 20, simhash._by_parts(4))
    near = {tuple(sorted((signed[a], signed[b]))) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4}
    assert near <= met and len(met) < len(prints) * (len(prints) - 1) / 2


@pytest.mark.parametrize("similar", [0.5, 0.8, 1.0])
def test_a_cut_by_rare_shingles_loses_no_link(spark, similar):
    rng = random.Random(5)
    sets = {}
    for i in range(200):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else {rng.randrange(500) for _ in range(rng.randrange(1, 30))} | set(range(1000, 1000 + rng.randrange(3)))
        own = {x for x in base if rng.random() > 0.1} | {rng.randrange(500) for _ in range(rng.randrange(3))}
        sets[i] = own or {1}
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "item long, shingles array<long>")
    met = cut_pairs(spark, [(1, i) for i in sets] + [(2, i) for i in range(4)], 20, blocking.by_rare_shingles(spark, frame, similar))
    near = {p for p in combinations(sets, 2) if len(sets[p[0]] & sets[p[1]]) >= similar * len(sets[p[0]] | sets[p[1]]) - 1e-9}
    assert near <= met and len(met) < 0.9 * 200 * 199 / 2 and len(near) > 20


def test_items_leave_as_they_come():
    read = []

    def batches():
        for k in range(300):
            read.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(1000, 5)), pa.array(np.arange(1000) + 1000 * k)], names=["bucket", "item"])

    out = blocking._numbered(8192)(batches())
    first = next(out)
    assert len(read) <= 2 and first.num_rows >= 1000
    total = first.num_rows + sum(b.num_rows for b in out)
    assert total == 300_000


def test_repeated_words_of_long_texts():
    tests = decontam.index([(1, b"for " * 1000), (2, b"for and " * 300), (3, b"to be or not " * 50)])
    hits = decontam.find_hits(b"for " * 100_000, tests)
    assert hits == [{"item_id": 1, "matched": 20, "window": 20, "start_word": 0}]
    hits = {h["item_id"]: h["matched"] for h in decontam.find_hits(b"x y z " * 1000 + b"to be or not " * 3000 + b"for and " * 20_000, tests)}
    assert hits == {2: 20, 3: 20}


def plain(doc, item):
    """The best window of all diagonals, the first of equal ones."""
    d, t = doc.split(), item.split()
    size = min(len(t), 20)
    best = None
    for diagonal in range(-len(t) + 1, len(d)):
        same = [0 <= diagonal + k < len(d) and d[diagonal + k] == t[k] for k in range(len(t))]
        for k in range(len(t) - size + 1):
            n = sum(same[k : k + size])
            if n >= 0.8 * size and (best is None or n > best[0]):
                best = n, diagonal + k
    return best


@pytest.mark.parametrize("seed", range(40))
def test_few_words_against_all_diagonals(seed):
    rng = random.Random(seed)
    words = "ab" if seed % 2 else "abcd"
    doc, item = (" ".join(rng.choice(words) * rng.randrange(1, 4) if seed % 3 else rng.choice(words) for _ in range(rng.randrange(5, n))) for n in (120, 60))
    found = decontam.find_hits(doc.encode(), decontam.index([(1, item.encode())]))
    best = plain(doc, item)
    assert [(h["matched"]) for h in found] == ([best[0]] if best else [])
