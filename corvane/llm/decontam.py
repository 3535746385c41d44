"""Benchmark passages in documents, found by spaced seeds.

Words are hashed; a fixed mask over a span of words ignores some positions, so
two passages that differ there still have the same hash. Test hashes are
joined with the documents' hashes, and each hit is verified on its diagonal: some
window of the test item must agree with the document in most of its words. The
masks of a window cover every set of substitutions that this allows, so no such
window is without a hit.

The test side goes to the executors in parts of a proven size. A benchmark beyond one
part's size takes several passes over the documents, and none of it is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from corvane.llm.storage import materialise
from corvane.llm.words import PUNCTUATION, joined, slabs, word_hashes

#: Words of an item that must be seen together, and the share of them that must agree.
WINDOW, AGREE = 20, 0.8
#: Items of fewer words match nothing.
LEAST = 5
#: Characters of benchmark text in one pass; each word has up to 15 seeds.
PASS_CHARS = 1_600_000
#: Words compared at a time.
SLAB = 1 << 20


def allowed(size: int, agree: float) -> int:
    """Words of a window that may differ."""
    return size - int(np.ceil(agree * size - 1e-9))


def _blocks(span: int, wrong: int) -> list[int]:
    """The block of each word of a span: two blocks more than the words that may differ."""
    blocks = min(wrong + 2, span)
    return [k * blocks // span for k in range(span)]


def masks(span: int, wrong: int) -> tuple[str, ...]:
    """The spaced seeds of a span: 1 is read, 0 is ignored.

    Each seed reads all blocks but as many as the words that may differ; wherever they
    stand, one seed ignores all their blocks.
    """
    block = _blocks(span, wrong)
    return tuple("".join("0" if b in out else "1" for b in block) for out in combinations(range(block[-1] + 1), wrong))


def span_for(size: int, window: int, agree: float) -> int:
    """The least span in which as many words may differ as in the window of an item of ``size`` words.

    Any window begins with such a span, and all lengths that allow as many have the same masks.
    """
    size = min(size, window)
    return next(n for n in range(1, size + 1) if allowed(n, agree) == allowed(size, agree)) if size < window else size


def hashes_of(text: bytes) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, ASCII punctuation and blanks between them."""
    return word_hashes(text, PUNCTUATION)[0]


def _multipliers(seed: int, n: int) -> np.ndarray:
    return np.array([xxh64_intdigest(f"{seed}:{k}") | 1 for k in range(n)], np.uint64)


def seed_hashes(words: np.ndarray, span: int, wrong: int) -> Iterator[np.ndarray]:
    """By mask one hash for each place at which the span fits; the blocks' sums are shared by the masks."""
    n = words.size - span + 1
    if n <= 0:
        return
    block, times = _blocks(span, wrong), _multipliers(span, span)
    sums = np.zeros((block[-1] + 1, n), np.uint64)
    for k, b in enumerate(block):
        sums[b] += words[k : k + n] * times[k]
    for out in combinations(range(block[-1] + 1), wrong):
        yield sum((sums[b] for b in range(1, block[-1] + 1) if b not in out), sums[0] if 0 not in out else np.zeros(n, np.uint64))


class Tests(NamedTuple):
    """Items' words end to end, and all their seed hashes in order."""

    ids: list
    words: np.ndarray
    starts: np.ndarray
    spans: tuple[tuple[int, int], ...]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray


def index(items: list[tuple[object, bytes]], window: int = WINDOW, agree: float = AGREE) -> Tests:
    """Every place of an item where a window begins has the seeds of that window."""
    words = [hashes_of(t) for _, t in items]
    used, hashes, item, place = set(), [], [], []
    for k, w in enumerate(words):
        if w.size < LEAST:
            continue
        span = span_for(w.size, window, agree)
        windows = w.size - min(w.size, window) + 1
        used.add((span, allowed(span, agree)))
        for h in seed_hashes(w, span, allowed(span, agree)):
            h = h[:windows]
            hashes.append(h)
            item.append(np.full(h.size, k))
            place.append(np.arange(h.size))
    flat = [np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((hashes, np.uint64), (item, np.int64), (place, np.int64))]
    order = np.argsort(flat[0], kind="stable")
    present = np.zeros(1 << 22, dtype=bool)
    present[(flat[0] >> np.uint64(42)).astype(np.int64)] = True
    starts = np.concatenate([[0], np.cumsum([w.size for w in words])]).astype(np.int64)
    return Tests([i for i, _ in items], np.concatenate(words) if words else np.empty(0, np.uint64), starts, tuple(sorted(used)), flat[0][order], flat[1][order], flat[2][order], present)


def _verify(doc: np.ndarray, test: np.ndarray, spans: list[tuple[int, int]], window: int, agree: float) -> tuple[int, int, int] | None:
    """The best window over all diagonals of some spans (last one included): matched words, its size, its first word in the document."""
    size, best = min(test.size, window), None
    need = int(np.ceil(agree * size - 1e-9))
    lead = test.size
    padded = np.concatenate([np.zeros(lead, np.uint64), doc, np.zeros(lead, np.uint64)])
    inside = np.concatenate([np.zeros(lead, bool), np.ones(doc.size, bool), np.zeros(lead, bool)])
    diagonals = np.concatenate([np.arange(a, b + 1) for a, b in spans])
    step = max(1, SLAB // test.size)
    for k in range(0, diagonals.size, step):
        at = diagonals[k : k + step, None] + lead + np.arange(test.size)
        same = np.cumsum((padded[at] == test) & inside[at], axis=1, dtype=np.int32)
        same = np.concatenate([np.zeros((same.shape[0], 1), np.int32), same], axis=1)
        in_window = same[:, size:] - same[:, :-size]
        top = int(in_window.argmax())
        row, col = divmod(top, in_window.shape[1])
        if (matched := int(in_window[row, col])) >= need and (best is None or matched > best[0]):
            best = matched, size, int(diagonals[k + row]) + col
            if matched == size:
                break
    return best


def _runs(places: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """First and last of each run of places that follow each other, within a group; one column each."""
    new = np.ones(places.size + 1, bool)
    new[1:-1] = places[1:] != places[:-1] + 1
    if groups is not None:
        new[1:-1] |= groups[1:] != groups[:-1]
    edges = np.flatnonzero(new)
    return np.stack([edges[:-1], edges[1:] - 1])


def _merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    by = np.argsort(low, kind="stable")
    low, high = low[by], np.maximum.accumulate(high[by])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1] + 1]))
    return list(zip(low[first].tolist(), high[np.append(first[1:], low.size) - 1].tolist(), strict=True))


#: Runs of one hash in a text or an item beyond which the span of all its diagonals is verified in place of each.
MANY = 64


def _diagonals(place: np.ndarray, seed: np.ndarray, tests: Tests) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Items and spans of diagonals on which a seed of a text is one of the item; ``seed`` is the first place of its hash in ``tests``.

    Words that repeat make runs of equal hashes. Two runs meet on a span of diagonals, so what is made grows with the runs and not
    with the product of their lengths.
    """
    following = np.minimum(seed + 1, tests.hashes.size - 1)
    several = (tests.hashes[following] == tests.hashes[seed]) & (following > seed)
    if not several.all():
        # a hash that is once among the items: its places are as many diagonals
        at = tests.place[seed[~several]]
        yield tests.item[seed[~several]], place[~several] - at, place[~several] - at
    place, seed = place[several], seed[several]
    if not place.size:
        return
    by = np.lexsort((place, seed))
    place, seed = place[by], seed[by]
    first, last = _runs(place, seed)
    # runs of the text by hash; a hash of many runs is taken as one
    hash_of = seed[first]
    start = np.flatnonzero(np.concatenate([[True], hash_of[1:] != hash_of[:-1]]))
    count = np.diff(np.append(start, hash_of.size))
    for s, n in zip(start.tolist(), count.tolist(), strict=True):
        low, high = place[first[s : s + n]], place[last[s : s + n]]
        if n > MANY:
            low, high = low[:1], high[-1:]
        a, b = int(hash_of[s]), int(np.searchsorted(tests.hashes, tests.hashes[hash_of[s]], "right"))
        f, e = _runs(tests.place[a:b], tests.item[a:b])
        item, from_, to = tests.item[a + f], tests.place[a + f], tests.place[a + e]
        if item.size > MANY:
            item, at = np.unique(item, return_index=True)
            from_, to = tests.place[a + f[at]], tests.place[a + e[np.append(at[1:], f.size) - 1]]
        yield np.repeat(item, low.size), np.subtract.outer(low, to).T.ravel(), np.subtract.outer(high, from_).T.ravel()


def find_all(texts: list[bytes], tests: Tests, window: int = WINDOW, agree: float = AGREE) -> list[list[dict]]:
    """For each text one entry for each item of which a window is in it, in item order."""
    hashes, text, _, _ = joined(texts, PUNCTUATION)
    sizes = np.bincount(text, minlength=len(texts))
    # windows may begin before a text or end after it by as many words as may differ
    edge = allowed(window, agree)
    starts = edge + np.cumsum(sizes + edge) - sizes - edge
    padded = np.zeros(int(sizes.sum()) + edge * (len(texts) + 1), np.uint64)
    padded[np.arange(hashes.size) + edge * (text + 1)] = hashes
    places, seeds = [], []
    for span, wrong in tests.spans:
        for h in seed_hashes(padded, span, wrong):
            there = np.flatnonzero(tests.present[(h >> np.uint64(42)).astype(np.int64)])
            seed = np.searchsorted(tests.hashes, h[there])
            seed[seed == tests.hashes.size] = 0
            same = tests.hashes[seed] == h[there]
            places.append(there[same])
            seeds.append(seed[same])
    out: list[list[dict]] = [[] for _ in texts]
    place, seed = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, seeds))
    owner = np.searchsorted(starts - edge, place, "right") - 1
    by = np.argsort(owner, kind="stable")
    place, seed, owner = place[by], seed[by], owner[by]
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if owner.size else np.empty(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        t = int(owner[a])
        doc = padded[starts[t] : starts[t] + sizes[t]]
        item, low, high = (np.concatenate(x) for x in zip(*_diagonals(place[a:b] - starts[t], seed[a:b], tests), strict=True))
        for k in np.unique(item):
            own = item == k
            best = _verify(doc, tests.words[tests.starts[k] : tests.starts[k + 1]], _merged(low[own], high[own]), window, agree)
            if best:
                out[t].append({"item_id": tests.ids[k], "matched": best[0], "window": best[1], "start_word": best[2]})
    return out


def find_hits(text: bytes, tests: Tests, window: int = WINDOW, agree: float = AGREE) -> list[dict]:
    return find_all([text], tests, window, agree)[0]


HIT = [("matched", T.LongType()), ("window", T.LongType()), ("start_word", T.LongType())]


def parts(benchmark: DataFrame, chars: int = PASS_CHARS) -> tuple[DataFrame, int]:
    """The items with the number of their part, and how many parts of about ``chars`` characters there are.

    Items go to a part by a hash of their text. A single item larger than that is a part with more.
    """
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // chars))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return benchmark.where(F.col("text").isNotNull()).select("item_id", F.col("text").cast("binary").alias("raw"), part.alias("part")), n


def passages(items: DataFrame, part: int, window: int = WINDOW, agree: float = AGREE):
    """One part of the benchmark, broadcast."""
    rows = items.where(F.col("part") == part).select("item_id", "raw").collect()
    return items.sparkSession.sparkContext.broadcast(index(sorted(((r.item_id, bytes(r.raw)) for r in rows), key=lambda r: (r[0] is None, *r)), window, agree))


def hits(text: Column, part, item_type: T.DataType, window: int = WINDOW, agree: float = AGREE) -> Column:
    """Array of the items of one part whose passages are in a text; null and empty texts have none."""
    kind = T.ArrayType(T.StructType([T.StructField("item_id", item_type), *[T.StructField(n, t) for n, t in HIT]]))
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([found for _, group in slabs(texts) for found in find_all(group, part.value, window, agree)], arrow)

    return found(text.cast("binary"))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE, chars: int = PASS_CHARS) -> DataFrame:
    """Rows ``doc_id, item_id, matched, window, start_word``, one for each document and item in it.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text``; other columns are not looked at. An item is in a document if
    on some alignment a window of min(its length, ``window``) words agrees in the share ``agree`` or more; the best
    window is reported, of equal ones the first in the document. Substituted words are tolerated, also inside the seeds; insertions split a
    passage into parts that count for themselves. Items of less than five words match nothing. Repeated rows give repeated results, and so do equal items; null texts,
    null items and empty tables give none. Texts of any length are searched whole. A benchmark of several parts takes a pass for each, one at a time.
    """
    item_type = benchmark.schema["item_id"].dataType
    items, n = parts(benchmark, chars)
    out = None
    for k in range(n):
        part = passages(items, k, window, agree)
        found = docs.select("doc_id", F.explode(hits(F.col("text"), part, item_type, window, agree)).alias("hit")).select("doc_id", "hit.*")
        if n > 1:
            found = materialise(spark, found, "hits")
            part.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: float = AGREE, chars: int = PASS_CHARS) -> DataFrame:
    """``docs`` without the rows in which some benchmark passage is, as in ``contaminated``; all columns stay, whatever their names.

    Rows with null and empty texts stay, and equal rows fare alike. Whole texts are searched, however long. An empty ``docs`` stays empty, and an empty benchmark removes nothing.
    """
    item_type = benchmark.schema["item_id"].dataType
    items, n = parts(benchmark, chars)
    for k in range(n):
        part = passages(items, k, window, agree)
        docs = docs.where(F.size(hits(F.col("text"), part, item_type, window, agree)) == 0)
        if n > 1:
            docs = materialise(spark, docs, "clean")
            part.destroy()
    return docs
