"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Fingerprints link if they differ in at most ``radius`` bits. Each bit
position gets a non-zero vector of radius + 1 bits; for each non-zero v the
mask of v keeps the positions whose vector has an odd inner product with v. The
vectors of up to ``radius`` differing positions span less than the whole space,
so some v is orthogonal to all of them: its mask drops every differing bit, and
the two fingerprints share that table's bucket. No pair within the radius is
missed, whatever the data. Equal fingerprints are one item from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.blocking import BLOCK, candidates, linked, paired, same
from corvane.llm.components import connected_components
from corvane.llm.similar import SIMILAR, similar_groups
from corvane.llm.storage import discard, materialise

SEED = 42
#: Shingles hashed at a time, which bounds the memory of a very long text.
STEP = 65536


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of UTF-8 text: A-Z lower-cased, split at ASCII blanks.

    Texts of fewer words are one shingle; texts of none have fingerprint 0.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    width = min(words, len(parts))
    joined, lengths = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(parts) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, starts.size, STEP):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + STEP].tolist(), ends[k : k + STEP].tolist(), strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > starts.size, bitorder="little").view("<u8")[0])


def masks(radius: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of the covering, as signed 64-bit numbers."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(bits)]
    found = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def covering(radius: int) -> Column:
    """The buckets of ``fp``, one for each mask: two fingerprints within the radius share at least one."""
    return F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(radius))])


def _fingerprints(words: int):
    def fn(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            prints = np.fromiter((fingerprint(t.as_py() or b"", words) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return fn


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (long, the bits of the fingerprint) of every row; a null text is empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_fingerprints(words), f"doc_id {kind}, fp long")


def _near(radius: int):
    def near_in(table: pa.Table):
        fp = table.column("item").to_numpy().view(np.uint64)
        return lambda i, others: np.bitwise_count(fp[others] ^ fp[i]) <= radius

    return near_in


def _by_parts(radius: int):
    """Cuts buckets of fingerprints: those within the radius agree in at least one of radius + 1 parts of their bits."""
    parts = [sum(1 << b for b in range(p, 64, radius + 1)) for p in range(radius + 1)]
    keys = [F.xxhash64("bucket", F.lit(k), F.col("item").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(parts)]
    return lambda rows: rows.select(F.explode(F.array(*keys)).alias("bucket"), "item")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row itself
    included. Null texts are empty; empty texts share fingerprint 0 and link like any
    other. Rows with a null id keep their links but never name a component; if a
    component has no other row its id is null. Repeated ids give repeated rows.
    An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    prints = materialise(spark, fingerprints(docs, id_col, text_col, words), "prints")
    first = materialise(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    found = candidates(spark, first.select(F.explode(covering(radius)).alias("bucket"), F.col("fp").alias("item")), block)
    groups = materialise(spark, connected_components(spark, linked(paired(spark, found, block, _by_parts(radius), radius + 1), _near(radius))), "groups")
    discard(spark, found)
    smallest = groups.join(first, groups["node"] == first["fp"]).groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    ids = materialise(
        spark,
        first.join(named.withColumn("grouped", F.lit(True)), "fp", "left").select("fp", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")),
        "ids",
    )
    discard(spark, first, groups)
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of smallest ``doc_id`` and text hash.

    Fingerprints of five-word shingles within ``radius`` bits are candidates by the covering, further ones by bands; texts link
    if these shingles have a Jaccard similarity of ``similar`` or more. A document is an id with a text: unrelated texts that share an id all stay. Rows
    without an id come last, so they go where an identified row is near. Null and empty texts are near each other.
    Of rows equal in id and text one stays. All columns stay, whatever their names; an empty table gives no rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))
    groups = similar_groups(spark, rows.select("id", "text_hash", F.col("row.text").cast("binary").alias("raw")), fingerprint, covering(radius), similar)
    keep = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("kept")).select("kept.id", "kept.text_hash")
    once = Window.partitionBy("id", "text_hash").orderBy(F.xxhash64("row"))
    kept = rows.alias("l").join(keep.alias("r"), same("l", "r", "id", "text_hash")).select("l.*")
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
