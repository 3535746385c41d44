"""Substring deduplication by MinHash banding of paragraphs.

A passage that was copied into another text rarely begins where a line does, so a
line is cut further at places that its words alone determine: where the hash of
a word and the one before is the smallest for some words around. Copies of a
passage are cut alike whatever stands around them. Each such paragraph has MinHash bands over
its word shingles; paragraphs that share a band are verified with their exact
Jaccard similarity, linked paragraphs form classes, and those that occur at several
places in runs of enough words are repeats, of which the first occurrence stays.

Equal paragraphs are one item from the start, so copies never form pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.blocking import BLOCK, by_rare_shingles, candidates, linked, paired, same
from corvane.llm.components import connected_components
from corvane.llm.storage import discard, materialise
from corvane.llm.words import joined, mix, powers, slabs

#: Words on either side among which a cut is the smallest, so that paragraphs within a line have more words than that.
AROUND = 7
SHINGLE, SIMILAR = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^2)^4 = 0.983, one at 0.9 with 0.999.
BANDS, ROWS = 4, 2
#: Parts from which a bucket is cut: a paragraph has about as many rare shingles.
CUT_FROM = 4
#: Words of a run of repeated paragraphs from which it counts.
RUN = 16

_ODD = np.array([xxh64_intdigest(f"minhash {k}") | 1 for k in range(BANDS * ROWS)], np.uint64)
_BASE = np.uint64(xxh64_intdigest("base") | 5)


class Cut(NamedTuple):
    """Paragraphs of ``SHINGLE`` words or more of some texts, then the lines of as many words that are no single paragraph (``line``).

    ``text``: which text; ``no``: the number within it (lines: 0); ``start``: the first word within it; ``words``; ``content``: a hash;
    ``whole``: a paragraph that is a line; ``keys``: band keys, ``BANDS`` among paragraphs and as many among lines; ``at``: the place in ``shingles``, which has one
    hash for each word at which one starts.
    """

    text: np.ndarray
    no: np.ndarray
    start: np.ndarray
    words: np.ndarray
    content: np.ndarray
    whole: np.ndarray
    line: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    shingles: np.ndarray


#: Contents that a task remembers; what it forgets is sent anew.
REMEMBERED = 1 << 20


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words; of each line with words, how many it has and its text."""
    found, text, start, raw = joined(texts)
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    first, sizes = np.unique(np.searchsorted(ends, start), return_index=True, return_counts=True)[1:]
    return found, sizes, text[first]


def _windows_at(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words."""
    total = np.full(max(0, h.size - width + 1), width, np.uint64)
    for k in range(width):
        total = mix(total * _BASE + h[k : k + total.size])
    return total


def cut(texts: list[bytes], banded: bool = True) -> Cut:
    """Texts together are cut as each alone, as no cut looks beyond its line; keys are empty unless ``banded``."""
    h, sizes, text_of = _words(texts)
    n = h.size
    v = h.copy()
    v[1:] = mix(h[1:] + h[:-1] * _ODD[0])
    line_starts = np.cumsum(sizes) - sizes
    v = np.maximum(v, np.uint64(1))
    v[line_starts] = 0
    top = np.full(AROUND, np.iinfo(np.uint64).max, np.uint64)
    # the end of the texts cuts like the end of a line, whose next word is 0
    padded = np.concatenate([top, v, np.zeros(AROUND, np.uint64)])
    is_cut = v < padded[AROUND - 1 : AROUND - 1 + n]
    for k in range(AROUND - 1):
        is_cut &= v < padded[k : k + n]
    for k in range(AROUND + 1, 2 * AROUND + 1):
        is_cut &= v <= padded[k : k + n]
    is_cut[line_starts] = True
    piece = np.flatnonzero(is_cut)
    piece_end = np.append(piece[1:], n)[: piece.size]
    long_enough = piece_end - piece >= SHINGLE
    piece, piece_end = piece[long_enough], piece_end[long_enough]
    base, backs = powers(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * base[:n], dtype=np.uint64)])
    shingles = mix((sums[SHINGLE:] - sums[:-SHINGLE]) * backs[: max(0, n - SHINGLE + 1)]) if n >= SHINGLE else np.empty(0, np.uint64)

    line_end = np.zeros(n, np.int64)
    line_end[line_starts] = line_starts + sizes
    whole = line_end[piece] == piece_end
    other = sizes >= SHINGLE
    other[np.isin(line_starts, piece[whole])] = False
    start, end = np.concatenate([piece, line_starts[other]]), np.concatenate([piece_end, (line_starts + sizes)[other]])
    line = np.arange(start.size) >= piece.size
    content = mix((sums[end] - sums[start]) * backs[start] + (end - start).astype(np.uint64))
    text = text_of[np.searchsorted(line_starts, start, "right") - 1] if n else start
    first = np.zeros(len(texts), np.int64)
    new = np.concatenate([[True], text_of[1:] != text_of[:-1]])[: text_of.size]
    first[text_of[new]] = line_starts[new]
    pieces_before = np.searchsorted(text[~line], np.arange(len(texts)))
    no = np.where(line, 0, np.arange(start.size) - pieces_before[text])
    keys = np.zeros((start.size if banded else 0, 2 * BANDS), np.uint64)
    if keys.size:
        # minima over the shingles that lie within a paragraph; the odd slices are what lies between
        bounds = np.stack([start, end - SHINGLE + 1], axis=1).ravel()
        for b in range(BANDS):
            key = np.full(start.size, b + 1, np.uint64)
            for r in range(ROWS):
                values = np.append(mix(shingles * _ODD[b * ROWS + r]), np.iinfo(np.uint64).max)
                key = mix(key * _BASE + np.minimum.reduceat(values, bounds)[::2])
            keys[:, b], keys[:, BANDS + b] = key, mix(key + _ODD[1])
    return Cut(text, no, start - first[text], end - start, content, np.concatenate([whole, np.ones(int(line.sum()), bool)]), line, keys, start, shingles)


PARAGRAPHS = "id long, text_hash long, no int, whole boolean, start_word long, n_words long, content long, keys array<long>"


def _cut_all(batches):
    """All paragraphs of each text, and its lines that are no single paragraph, which have no number; of equal ones in a task the first has keys."""
    seen: set[int] = set()
    for batch in batches:
        for begin, texts in slabs(batch.column("raw")):
            c = cut(texts)
            content, owner = c.content.view(np.int64), pa.array(c.text + begin)
            fresh = np.zeros(content.size, bool)
            fresh[np.unique(content, return_index=True)[1]] = True
            fresh[[k for k in np.flatnonzero(fresh).tolist() if int(content[k]) in seen]] = False
            seen = (seen if len(seen) < REMEMBERED else set()) | set(content[fresh].tolist())
            wanted = np.repeat(np.stack([fresh & ~c.line, fresh & c.whole], axis=1), BANDS, axis=1)
            sizes = np.concatenate([[0], np.cumsum(wanted.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(owner),
                    batch.column("text_hash").take(owner),
                    pa.array(c.no.astype(np.int32), mask=c.line),
                    pa.array(c.whole),
                    pa.array(c.start),
                    pa.array(c.words),
                    pa.array(content),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(c.keys[wanted].view(np.int64))),
                ],
                names=["id", "text_hash", "no", "whole", "start_word", "n_words", "content", "keys"],
            )


def _shingles_of(batches):
    """The sorted distinct shingles of the wanted paragraphs of each text."""
    for batch in batches:
        for begin, texts in slabs(batch.column("raw")):
            c = cut(texts, banded=False)
            content = c.content.view(np.int64)
            wanted = batch.column("wanted").slice(begin, len(texts)).flatten().to_numpy()
            items, place = np.unique(content, return_index=True)
            place = place[np.isin(items, wanted)]
            sets = [np.unique(c.shingles[a : a + n - SHINGLE + 1]).view(np.int64) for a, n in zip(c.at[place].tolist(), c.words[place].tolist(), strict=True)]
            sizes = np.concatenate([[0], np.cumsum([x.size for x in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(content[place]), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=["item", "shingles"])


def _around(width: int):
    """A hash of each run of ``width`` words in which a given paragraph lies, and where the run starts."""

    def fn(batches):
        for batch in batches:
            owner, out = [], [[], [], []]
            for k, (text, spans) in enumerate(zip(batch.column("raw"), batch.column("spans").to_pylist(), strict=True)):
                found = _windows_at(_words([text.as_py() or b""])[0], width).view(np.int64)
                for span in spans:
                    a, n = span["start_word"], span["n_words"]
                    at = np.arange(max(0, a + n - width), min(a, found.size - 1) + 1)
                    owner.append(np.full(at.size, k))
                    for column, value in zip(out, (np.full(at.size, a), at, found[at]), strict=True):
                        column.append(value)
            owner, *out = (np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in (owner, *out))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), batch.column("text_hash").take(pa.array(owner)), *map(pa.array, out)], names=["id", "text_hash", "start_word", "at", "window"])

    return fn


def _near(similar: float):
    def near_in(table: pa.Table):
        sets = table.column("shingles").combine_chunks()
        flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        at, mark = np.cumsum(sizes) - sizes, np.zeros(flat.max() + 1, bool)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            own = flat[at[i] : at[i] + sizes[i]]
            mark[own] = True
            n = sizes[others]
            first = np.cumsum(n) - n
            shared = np.add.reduceat(mark[flat[np.arange(n.sum()) + np.repeat(at[others] - first, n)]], first, dtype=np.int64)
            mark[own] = False
            return shared >= similar * (n + own.size - shared) - 1e-9

        return near

    return near_in


def repeats(spark: SparkSession, docs: DataFrame, similar: float = SIMILAR, run: int = RUN, line_run: int = RUN, block: int = BLOCK) -> DataFrame:
    """The repeated paragraphs of ``docs`` (``doc_id, text``), one row each.

    Returns ``doc_id, paragraph`` (its number among those of five words or more; null for a line that is several), ``start_word,
    n_words, class_id`` (equal for similar paragraphs), ``first_doc_id`` and ``removed`` (false for the
    occurrence of the smallest doc_id and paragraph, which stays). A paragraph counts if its class is at two
    places or more, of one document or of several, and it stands in a run of such paragraphs of ``run`` words or more in all, or in ``run``
    words that stand as they are around another repeat, or if it is a whole line of ``line_run`` words or more; ``run=0`` takes all.
    Words are split at ASCII blanks, A-Z lower-cased. Null and empty texts, and those of less than five words, have no
    paragraphs. A document is an id with a text: rows equal in both count once, so a text repeated under one id is no repeat, and different texts of
    an id are different documents. Rows without an id come after all others. Other columns are not looked at; an empty table gives no rows.
    Whole texts are cut into paragraphs, however long; a text's paragraphs are made in one task, in slabs.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    doc = ("id", "text_hash")
    at = lambda *more: F.struct(F.col("id").isNull().alias("no_id"), *doc, *more)
    all_ = materialise(spark, texts.mapInArrow(_cut_all, PARAGRAPHS), "paragraphs")
    rows = all_.select(F.explode("keys").alias("bucket"), F.col("content").alias("item"))
    found = candidates(spark, rows, block)
    # only what stands at two places or shares a band with something else can be in a class that counts
    items = found.select(F.col("item").alias("content")).distinct()
    several = all_.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    relevant = materialise(spark, several.union(items).distinct(), "relevant")
    near = materialise(spark, all_.select(*doc, "no", "whole", "start_word", "n_words", "content").join(relevant, "content", "left_semi"), "near")
    discard(spark, all_, relevant)
    # the places between which each paragraph occurs; in the first document it is looked up where it has to be verified
    end = (F.col("start_word") + F.col("n_words")).alias("end")
    spread = near.groupBy("content").agg(F.min(at("start_word", end)).alias("first"), F.max(at("start_word")).alias("last"), F.min(at(end)).alias("ended"))
    spread = materialise(spark, spread, "spread")
    wanted = spread.join(items, "content").groupBy("first.id", "first.text_hash").agg(F.collect_set("content").alias("wanted"))
    looked_up = texts.alias("l").join(wanted.alias("r"), same("l", "r", *doc)).select("l.raw", "r.wanted")
    sets = materialise(spark, looked_up.mapInArrow(_shingles_of, "item long, shingles array<long>").dropDuplicates(["item"]), "shingles")
    pairs = paired(spark, found, block, by_rare_shingles(spark, sets, similar), CUT_FROM)
    links = linked(pairs.join(sets, "item").select("bucket", "i", "j", "item", "shingles"), _near(similar))
    classes = materialise(spark, connected_components(spark, links), "classes")
    discard(spark, found, sets)
    classed = spread.join(classes.withColumnRenamed("node", "content"), "content", "left").withColumn("class_id", F.coalesce("component", "content"))
    # a line and a paragraph in it can be of one class: two places are where one begins after the other ended
    wide = classed.groupBy("class_id").agg(F.min("first").alias("at"), F.max("last").alias("last"), F.min("ended").alias("ended"))
    apart = ~(F.struct("last.id", "last.text_hash").eqNullSafe(F.struct("ended.id", "ended.text_hash")))
    wide = wide.where(apart | (F.col("last.start_word") >= F.col("ended.end"))).select("class_id", "at")
    known = materialise(spark, classed.select("content", "class_id").join(wide, "class_id"), "repeated")
    discard(spark, spread, classes)
    hits = near.join(known, "content").dropDuplicates([*doc, "start_word", "n_words"])
    stays = F.struct(*doc).eqNullSafe(F.struct("at.id", "at.text_hash")) & (F.col("start_word") < F.col("at.end"))
    hits = materialise(spark, hits.withColumn("removed", ~stays).withColumn("first", F.col("at.id")).drop("at"), "hits")
    discard(spark, near, known)
    runs = hits.where("no is not null").withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(*doc).orderBy("no")))
    runs = materialise(spark, runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy(*doc, "run"))), "runs")
    counts = (F.col("run_words") >= run) | (F.col("whole") & (F.col("n_words") >= line_run))
    # words around those that don't count yet are compared with the words around all of the same class
    short = runs.where(~counts)
    alike = runs.join(short.select("class_id").distinct(), "class_id", "left_semi")
    spans = alike.groupBy(*doc).agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    looked_up = texts.alias("l").join(spans.alias("r"), same("l", "r", *doc)).select("l.id", "l.text_hash", "l.raw", "r.spans")
    around = materialise(spark, looked_up.mapInArrow(_around(run), "id long, text_hash long, start_word long, at long, window long"), "around")
    # stored, so that both sides of the join are plain exchanges, whose large partitions can be split
    again = materialise(spark, around.groupBy("window").agg(F.min(at("at")).alias("a"), F.max(at("at")).alias("b")).where("a <> b").select("window"), "again")
    longer = around.join(again, "window").select(*doc, "start_word").distinct()
    columns = ["id", "no", "start_word", "n_words", "class_id", "first", "removed"]
    extended = short.alias("l").join(longer.alias("r"), same("l", "r", *doc, "start_word"), "left_semi").select(*columns)
    lines = hits.where(F.col("no").isNull() & (F.col("n_words") >= line_run))
    out = runs.where(counts).select(*columns).unionByName(extended).unionByName(lines.select(*columns))
    return out.select(F.col("id").alias("doc_id"), F.col("no").alias("paragraph"), "start_word", "n_words", "class_id", F.col("first").alias("first_doc_id"), "removed")
