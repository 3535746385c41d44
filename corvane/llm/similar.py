"""Texts whose sets of word shingles have a Jaccard similarity of a threshold or more.

Texts of equal words are one item from the start. Items that share a table of the
covering of their SimHash fingerprints are candidates, so no pair within its radius is
missed; pairs at the threshold are often further apart, and MinHash bands bring those
together. Each candidate is verified with the exact similarity of its shingles, so tables and
bands decide what is compared and never what links.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.blocking import by_rare_shingles, candidates, linked, paired, same
from corvane.llm.components import connected_components
from corvane.llm.paragraphs import _near
from corvane.llm.storage import discard, materialise
from corvane.llm.words import mix, powers, word_hashes

SHINGLE, SIMILAR = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^3)^14 = 0.99996.
BANDS, ROWS = 14, 3
#: Items of a bucket in a block; their shingles are in memory together.
BLOCK = 1024
#: Parts from which a bucket is cut: a text of 150 words has about as many rare shingles.
CUT_FROM = 32

_ODD = np.array([xxh64_intdigest(f"similar {k}") | 1 for k in range(BANDS * ROWS)], np.uint64)
_PLACE = np.array([xxh64_intdigest(f"place {k}") | 1 for k in range(SHINGLE)], np.uint64)


def shingles(text: bytes) -> tuple[int, np.ndarray]:
    """A hash of all words, and one of each shingle: A-Z lower-cased, split at ASCII blanks.

    Texts of fewer words are one shingle, also those of none.
    """
    h, _ = word_hashes(text)
    width = min(SHINGLE, h.size)
    total = np.full(h.size - width + 1, width, np.uint64)
    for k in range(width):
        total += h[k : k + total.size] * _PLACE[k]
    return int(mix((h * powers(h.size)[0][: h.size]).sum(keepdims=True, dtype=np.uint64) + np.uint64(h.size))[0]), mix(total)


def bands(found: np.ndarray) -> np.ndarray:
    least = mix(np.array([(found * odd).min() for odd in _ODD], np.uint64))
    return np.array([xxh64_intdigest(np.array([b, *least[b * ROWS : (b + 1) * ROWS]], np.uint64).tobytes()) for b in range(BANDS)], np.uint64)


def _items(fingerprint: Callable[[bytes, int], int]):
    def fn(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("raw")]
            both = [shingles(t) for t in texts]
            items = np.array([i for i, _ in both], np.uint64).view(np.int64)
            prints = np.array([fingerprint(t, SHINGLE) for t in texts], np.uint64).view(np.int64)
            keys = np.array([bands(s) for _, s in both], np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(items), pa.array(prints), lists], names=["id", "text_hash", "item", "fp", "keys"])

    return fn


def _sets(batches):
    for batch in batches:
        both = [shingles(t.as_py() or b"") for t in batch.column("raw")]
        sets = pa.array([np.unique(s).view(np.int64) for _, s in both], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.array([i for i, _ in both], np.uint64).view(np.int64)), sets], names=["item", "shingles"])


def itemised(texts: DataFrame, fingerprint: Callable[[bytes, int], int]) -> DataFrame:
    """``id, text_hash, item, fp, keys`` of each row: a hash of its words, the fingerprint of its shingles, and its bands."""
    return texts.mapInArrow(_items(fingerprint), "id long, text_hash long, item long, fp long, keys array<long>")


def buckets(items: DataFrame, tables: Column) -> DataFrame:
    """``bucket, item`` for each table of the covering and each band; ``tables`` are those of ``fp``."""
    return items.select(F.explode(F.concat(tables, "keys")).alias("bucket"), "item")


def similar_groups(spark: SparkSession, texts: DataFrame, fingerprint: Callable[[bytes, int], int], tables: Column, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """``id, text_hash, component`` for each row of ``texts`` (``id, text_hash`` long, ``raw`` binary, null as empty).

    Rows are in one component if links between texts of ``similar`` or more join them. ``fingerprint`` gives that of a text by shingles of so
    many words, and ``tables`` the buckets of its covering out of ``fp``. ``text_hash`` tells
    apart the texts of an id; an id may be null. An empty table gives no rows.
    """
    items = materialise(spark, itemised(texts, fingerprint), "items")
    place = F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("at")
    first = materialise(spark, items.groupBy("item").agg(place, F.first("fp").alias("fp"), F.first("keys").alias("keys")), "first")
    found = candidates(spark, buckets(first, tables), block)
    # near copies share most bands: of buckets that hold the same items one is searched
    alike = found.groupBy("bucket").agg(F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"))
    once = alike.groupBy("sum", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    found, all_ = materialise(spark, found.join(once, "bucket"), "once"), found
    discard(spark, all_)
    wanted = first.join(found.select("item").distinct(), "item").select("at.id", "at.text_hash")
    there = texts.alias("l").join(wanted.alias("r"), same("l", "r", "id", "text_hash")).select("l.raw")
    sets = materialise(spark, there.mapInArrow(_sets, "item long, shingles array<long>").dropDuplicates(["item"]), "shingles")
    pairs = paired(spark, found, block, by_rare_shingles(spark, sets, similar), CUT_FROM)
    links = linked(pairs.join(sets, "item").select("bucket", "i", "j", "item", "shingles"), _near(similar))
    groups = materialise(spark, connected_components(spark, links), "groups")
    discard(spark, first, found, sets)
    return items.join(groups.withColumnRenamed("node", "item"), "item", "left").select("id", "text_hash", F.coalesce("component", "item").alias("component"))
