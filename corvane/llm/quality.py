"""Quality scores from compression with dictionaries of good and bad text.

One Zstandard dictionary is trained on blocks of good labelled text and one on bad.
A text is compressed block by block with each; the difference of the two sizes
over their sum, and the size that the good dictionary leaves for each byte,
go through a logistic curve fitted on other labelled texts, which makes the score
a probability. Labels come only from rows outside the held-out fold.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled documents of each class, two blocks of each, in its dictionary at most; labelled documents in the curve at most.
DICTIONARY_DOCS, CURVE_DOCS = 3000, 4000
BLOCK, DICTIONARY_BYTES, LEVEL = 1024, 112_640, 3
FOLDS, THRESHOLD, RIDGE = 5, 0.3, 0.1


class Model(NamedTuple):
    """``good`` and ``bad``: dictionaries; an empty ``weights`` means that one class had no example, and ``prior`` is every score."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def held_out(id_col: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


_compressors: dict[tuple[bytes, bytes], list[zstandard.ZstdCompressor]] = {}


def _pair(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    if (good, bad) not in _compressors:
        _compressors.clear()
        pair = []
        for raw in (bad, good):
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=LEVEL)
            pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors[good, bad] = pair
    return _compressors[good, bad]


def features(text: bytes, good: bytes, bad: bytes) -> list[float]:
    """1, the normalised difference, the bytes left a byte, and their squares and product."""
    size_bad, size_good = (sum(len(c.compress(text[k : k + BLOCK])) for k in range(0, max(1, len(text)), BLOCK)) for c in _pair(good, bad))
    d, r = (size_bad - size_good) / (size_bad + size_good), size_good / max(1, len(text))
    r = min(r, 2.0)
    return [1.0, d, r, d * d, r * r, d * r]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by damped Newton steps; the weights are for raw features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0.0, 1.0
    z, ridge = (x - mean) / scale, np.full(x.shape[1], RIDGE)
    ridge[0] = 1e-6

    def loss(w):
        m = np.clip(z @ w, -30, 30)
        return float(np.sum(np.log1p(np.exp(m)) - y * m) + 0.5 * np.sum(ridge * w * w))

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _logistic(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    raw = w / scale
    raw[0] = w[0] - float(np.sum(w[1:] * mean[1:] / scale[1:]))
    return tuple(float(v) for v in raw)


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = FOLDS, dictionary_docs: int = DICTIONARY_DOCS, curve_docs: int = CURVE_DOCS) -> Model:
    """Learn from ``labels`` (``doc_id, quality``) of ``docs`` (``doc_id, text``) outside the held-out fold.

    The labelled rows form a bounded sample in the order of a hash of their id: the driver gets
    two blocks of each of ``dictionary_docs`` documents a class, and a few numbers for each of ``curve_docs``
    others, whose whole texts the executors compress. An id with several labels has their smallest;
    null labels and ids teach nothing, and null texts are empty ones. Empty tables, or labels of one class alone, give a model without dictionaries, by which every score is the smoothed share of good labels. Columns beside
    those named are not looked at.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = known.where(~held_out(F.col("doc_id"), folds)).join(docs.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2))
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = F.ceil(F.greatest(F.length("text"), F.lit(1)) / BLOCK)
    pick = F.array(*[F.expr(f"substring(text, cast(1 + {BLOCK} * pmod(xxhash64({k}, doc_id), _parts) as int), {BLOCK})") for k in range(2)])
    dictionaries = []
    for y in (1, 0):
        ids = known.where((half == 0) & (F.col("y") == y)).orderBy(order).limit(dictionary_docs)
        rows = text.join(F.broadcast(ids), "doc_id").withColumn("_parts", parts).select("doc_id", pick.alias("blocks")).orderBy("doc_id", "blocks").limit(dictionary_docs)
        dictionaries.append([b.encode() for r in rows.collect() for b in r.blocks if b])
    ids = known.where(half == 1).orderBy(order).limit(curve_docs)
    counts = dict(ids.groupBy("y").count().collect())
    prior = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    if not all(dictionaries) or min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return Model(b"", b"", (), prior)
    good, bad = map(_dictionary, dictionaries)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py(), good, bad) for t in texts], pa.list_(pa.float64()))

    rows = text.join(F.broadcast(ids), "doc_id").select("y", measured(F.col("text").cast("binary")).alias("x")).orderBy(F.xxhash64("x"), "y").limit(2 * curve_docs).collect()
    return Model(good, bad, fit_curve(np.array([r.x for r in rows]), np.array([r.y for r in rows], float)), prior)


def score(text: Column, model: Model) -> Column:
    """The probability that a text is good. Null texts are empty; every text has a score."""
    if not model.weights:
        return F.lit(float(model.prior))
    good, bad, weights = model.good, model.bad, np.array(model.weights)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([features(t.as_py() or b"", good, bad) for t in texts]).reshape(-1, len(weights))
        return pa.array(_logistic(x @ weights), pa.float64())

    return scored(text.cast("binary"))
