"""Stretches of words that repeat with a period, found by names of all stretches of 1, 2, 4, ... words.

A word's name is the place where it first stands in its text; the name of a stretch of 2 n words comes from the names of its two halves. Equal
names are equal stretches, so nothing is hashed and no suffixes are sorted. Only places whose stretch occurs
again are named further, which in ordinary text are soon few.

A run of period q that is long enough holds two neighbouring multiples of q from which so many equal words go on that two names show it. The first such
place of each run is extended both ways by the names, from the longest down. Places on the grids of all periods add up to n log n.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.words import slabs

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Places that are extended at once.
CHUNK = 1 << 18


def names_of(words: list[list[bytes]]) -> Iterator[np.ndarray]:
    """For the words of all texts in a row, the names of the stretches of 1, 2, 4, ... words that start at each; -1 where nothing in the same text is equal.

    The stretches that go beyond a text's end have names of their own, as texts share no words' names.
    """
    name, base = [], 0
    for own in words:
        first: dict[bytes, int] = {}
        name.append(np.fromiter(map(first.setdefault, own, count(base)), np.int64, len(own)))
        base += len(own)
    name = np.concatenate([*name, np.empty(0, np.int64)])
    often = np.bincount(name, minlength=base) > 1
    name[~often[name]] = -1
    width = 1
    while True:
        yield name
        at = np.flatnonzero(name[: max(0, base - width)] >= 0)
        at = at[name[at + width] >= 0]
        _, which, times = np.unique(name[at] * base + name[at + width], return_inverse=True, return_counts=True)
        if not (times > 1).any():
            return
        name = np.full(base, -1)
        name[at] = np.where(times[which] > 1, which, -1)
        width *= 2


def _same(name: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether named stretches at two places are equal; places outside the texts are not."""
    inside = (i >= 0) & (j < name.size)
    found = np.full(i.size, -1)
    found[inside] = name[i[inside]]
    return (found >= 0) & (found == name[np.where(inside, j, 0)])


def _grid(names: list[np.ndarray], q: int) -> np.ndarray:
    """The first multiples of q in each row of them from which q apart so many words are equal that a run may be long enough."""
    need = max(LEAST_WORDS, LEAST_PERIODS * q) - 2 * q + 1
    level = need.bit_length() - 1
    name, shift = names[level], need - (1 << level)
    i = np.arange(0, name.size - q, q)
    i = i[(name[i] >= 0) & (name[i] == name[i + q])]
    i = i[_same(name, i + shift, i + shift + q)] if shift and i.size else i
    return i[np.diff(i, prepend=-2 * q) != q]


def _extended(names: list[np.ndarray], i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of period q around each place begins, and where it ends."""
    low, high = i.copy(), i.copy()
    for level in range(len(names) - 1, -1, -1):
        high += _same(names[level], high, high + q).astype(np.int64) << level
    for level in range(len(names) - 1, -1, -1):
        step = 1 << level
        low -= _same(names[level], low - step, low - step + q).astype(np.int64) << level
    return low, high + q


def runs(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (counted over all texts), length and least period of every run, by start, then period. No run goes from one text to the next."""
    longest = max(map(len, words), default=0)
    names, found = list(names_of(words)), []
    waiting, held = [], 0

    def extend() -> None:
        i, q = (np.concatenate(x) for x in zip(*waiting, strict=True))
        low, high = _extended(names, i, q)
        enough = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.stack([low[enough], high[enough], q[enough]]))
        waiting.clear()

    # the words that must be equal grow with the period from its third part of the least length on
    for q in range(1, longest // LEAST_PERIODS + 1):
        need = max(LEAST_WORDS, LEAST_PERIODS * q) - 2 * q + 1
        if need.bit_length() > len(names):
            if LEAST_PERIODS * q >= LEAST_WORDS:
                break
            continue
        places = _grid(names, q)
        if places.size:
            waiting.append((places, np.full(places.size, q)))
            held += places.size
            if held >= CHUNK:
                extend()
                held = 0
    if waiting:
        extend()
    if not found:
        return (np.empty(0, np.int64),) * 3
    low, high, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, high, low))
    low, high, q = low[order], high[order], q[order]
    # a period's multiples give the same stretch again
    new = np.ones(low.size, bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    low, high, q = low[new], high[new], q[new]
    order = np.lexsort((q, low))
    return low[order], (high - low)[order], q[order]


def kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay if of every run only the first period does."""
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, start + period, 1)
    np.add.at(inside, start + length, -1)
    return np.cumsum(inside[:n]) == 0


RUN = T.StructType([T.StructField(f, T.LongType(), False) for f in ("start", "length", "period")])
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]


def _group(words: list[list[bytes]]) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    start, length, period = runs(words)
    first = np.cumsum([0] + [len(w) for w in words])
    stay = kept(int(first[-1]), start, length, period)
    bounds = np.searchsorted(start, first)
    collapsed = []
    for k, own in enumerate(words):
        if bounds[k] == bounds[k + 1]:
            collapsed.append(b" ".join(own))
        else:
            collapsed.append(b" ".join([own[j] for j in np.flatnonzero(stay[first[k] : first[k + 1]]).tolist()]))
    each = [np.stack([start[a:b] - first[k], length[a:b], period[a:b]]) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
    return [len(w) for w in words], each, collapsed


def find(docs: DataFrame) -> DataFrame:
    """Of each row of ``docs`` (``doc_id, text``): ``n_words``, ``runs`` by start, then period, and ``collapsed``, its words without those that a run repeats, joined by blanks.

    Words stand between ASCII blanks, and whole texts are searched, however long. Null and empty texts have no words and no runs,
    and their collapsed text is empty; equal texts have equal results. Every row has one, also with a null or repeated id; other columns are not read.
    """
    fields = [pa.field(f.name, pa.int64(), nullable=False) for f in RUN]
    of_runs = pa.list_(pa.field("element", pa.struct(fields), nullable=False))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in slabs(batch.column("text")):
                sizes, each, collapsed = _group([t.split() for t in group])
                values = np.concatenate([np.empty((3, 0), np.int64), *each], axis=1)
                offsets = pa.array(np.cumsum([0] + [e.shape[1] for e in each]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for v in values], fields=fields), type=of_runs)
                columns = [batch.column("doc_id").slice(first, len(group)), pa.array(sizes, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f.name for f in FOUND]])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(found, T.StructType([docs.schema["doc_id"], *FOUND]))


def strongest(runs_col: Column) -> Column:
    """Of an array of runs in their order, the one with most periods by exact comparison, then the first; null if there is none."""
    return F.reduce(runs_col, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
