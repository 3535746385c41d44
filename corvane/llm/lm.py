"""Language-model scores from a weighted backoff automaton.

Counts of n-grams over the training texts are smoothed with a Dirichlet prior:
P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), h' being h without its first word, down to
P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Each context of the model is a state. A state
has an arc for each word seen after it, with the smoothed log-probability, and a failure
arc to the state of h' that costs log10(m / (c(h) + m)). A text is read once from left
to right: the state is carried, failure arcs are taken until an arc fits, and the
weights add up.

No machine holds the model. Texts are dealt into blocks of bounded size as they are read, and each block is stored as tokens; it counts its
own n-grams and sends them, packed, to ranges of n-gram hashes; a range adds up the counts of all
blocks and sends back what the others add to each. With that and its own counts a block has the part of the
automaton that its texts can visit. Orders are counted one after the other, so the disk holds the packed n-grams
of one order and not of all.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm.storage import materialise
from corvane.llm.words import words_of

ORDER, PRIOR, ADDED = 3, 4.0, 0.1
FOLDS = 10
#: Bytes of text from which a block is full.
BLOCK_BYTES = 6_000_000
#: N-grams of all blocks in a range, about.
RANGE_KEYS = 3_000_000
#: Tokens that one lane of the traversal reads; a longer text is read by several lanes.
LANE = 256
#: The hash of the end token.
END = np.uint64(xxh64_intdigest("end of text"))

#: The bits by which n-grams of several tokens are told apart; what is left of a hash decides how much is sent.
SHORT = np.uint64(0xFFFFFFFFFFFFFF00)

_ODD = np.uint64(xxh64_intdigest("gram") | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block(NamedTuple):
    """Token ids of all texts end to end, each text's first place, and by order of the n-grams: for each
    place the n-gram that ends there (-1: the text is too short), and for each n-gram its hash, its context's
    number, its last token and the number of the n-gram without its first token."""

    tokens: np.ndarray
    starts: np.ndarray
    gram: list[np.ndarray]
    keys: list[np.ndarray]
    context: list[np.ndarray]
    last: list[np.ndarray]
    suffix: list[np.ndarray]


def tokenise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of all texts, the tokens of each text, and the hash of each number's token; frequent ones have small numbers.

    Lower-cases A-Z, splits at ASCII blanks and adds the end token to each text.
    """
    found, text = words_of(texts)
    sizes = np.bincount(text, minlength=len(texts)) + 1
    ends = np.cumsum(sizes) - 1
    all_ = np.full(found.size + len(texts), END)
    all_[np.delete(np.arange(all_.size), ends)] = found
    hashes, number, times = np.unique(all_, return_inverse=True, return_counts=True)
    by = np.argsort(-times, kind="stable")
    rank = np.empty(by.size, np.int64)
    rank[by] = np.arange(by.size)
    return rank[number], sizes, hashes[by]


def grams(tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, order: int) -> Block:
    starts = np.cumsum(sizes) - sizes
    # numbers within a block are below 2^31
    small, tokens = np.int32, tokens.astype(np.int32)
    place = (np.arange(tokens.size) - np.repeat(starts, sizes)).astype(small)
    none = np.zeros(hashes.size, small)
    block = Block(tokens, starts, [tokens], [_mix(hashes)], [none], [np.arange(hashes.size, dtype=small)], [none])
    for n in range(2, order + 1):
        at = np.flatnonzero(place >= n - 1)
        pairs = block.gram[-1][at - 1] * np.int64(hashes.size) + tokens[at]
        found, first, back = np.unique(pairs, return_index=True, return_inverse=True)
        gram = np.full(tokens.size, -1, small)
        gram[at] = back
        context, last = (found // hashes.size).astype(small), (found % hashes.size).astype(small)
        block.suffix.append(block.gram[-1][at[first]])
        block.gram.append(gram)
        block.keys.append(_mix(block.keys[-1][context] * _ODD + hashes[last] + np.uint64(n)))
        block.context.append(context)
        block.last.append(last)
    return block


def read(texts: list[bytes], order: int) -> Block:
    return grams(*tokenise(texts), order)


def count(block: Block, train: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the block's n-grams of one order and their counts in its training texts; those of single tokens are odd, those of more end in eight zero bits."""
    weight = np.repeat(train, np.diff(np.append(block.starts, block.tokens.size)))
    gram, keys = block.gram[n - 1], block.keys[n - 1]
    there = gram >= 0
    return keys & SHORT if n > 1 else keys | np.uint64(1), np.bincount(gram[there], weight[there], keys.size).astype(np.int64)


class Automaton(NamedTuple):
    """State 0 is the root. ``arcs``: state * tokens + token, ascending, with weights and next states; the root's arcs go by token."""

    size: int
    root_weight: np.ndarray
    root_next: np.ndarray
    arcs: np.ndarray
    weight: np.ndarray
    next: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray


def build(block: Block, totals: list[np.ndarray], tokens: int, types: int, prior: float) -> Automaton:
    order, size = len(totals), block.keys[0].size
    p = [(totals[0] + ADDED) / (tokens + ADDED * (types + 1))]
    for n in range(1, order):
        seen = totals[n - 1][block.context[n]]
        p.append(np.where(seen > 0, (totals[n] + prior * p[n - 1][block.suffix[n]]) / (seen + prior), p[n - 1][block.suffix[n]]))
    state, used = [], 1
    for n in range(order - 1):
        known = totals[n] > 0
        state.append(np.where(known, used - 1 + np.cumsum(known), 0))
        used += int(known.sum())
    state = state or [np.zeros(size, np.int64)]
    fail, fail_weight = np.zeros(used, np.int64), np.zeros(used)
    for n in range(order - 1):
        known = totals[n] > 0
        own = state[n][known]
        fail[own] = state[n - 1][block.suffix[n][known]] if n else 0
        fail_weight[own] = np.log10(prior / (totals[n][known] + prior))
    arcs, weight, after = [], [], []
    for n in range(1, order):
        known = totals[n] > 0
        arcs.append(state[n - 1][block.context[n][known]] * size + block.last[n][known])
        weight.append(np.log10(p[n][known]))
        after.append(state[n][known] if n < order - 1 else state[n - 1][block.suffix[n][known]])
    flat = [np.concatenate(x) if x else np.empty(0, k) for x, k in ((arcs, np.int64), (weight, float), (after, np.int64))]
    by = np.argsort(flat[0])
    return Automaton(size, np.log10(p[0]), state[0] if order > 1 else np.zeros(size, np.int64), flat[0][by], flat[1][by], flat[2][by], fail, fail_weight)


def _step(a: Automaton, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every lane reads one token: its weight, failures included, and its next state."""
    total, after = np.zeros(state.size), np.empty_like(state)
    open_ = np.arange(state.size)
    while open_.size:
        s, t = state[open_], token[open_]
        root = s == 0
        total[open_[root]] += a.root_weight[t[root]]
        after[open_[root]] = a.root_next[t[root]]
        open_, s, t = open_[~root], s[~root], t[~root]
        if not open_.size:
            break
        key = s * a.size + t
        at = np.minimum(np.searchsorted(a.arcs, key), max(0, a.arcs.size - 1))
        fits = a.arcs[at] == key if a.arcs.size else np.zeros(key.size, bool)
        total[open_[fits]] += a.weight[at[fits]]
        after[open_[fits]] = a.next[at[fits]]
        open_, s = open_[~fits], s[~fits]
        total[open_] += a.fail_weight[s]
        state = state.copy()
        state[open_] = a.fail[s]
    return total, after


def traverse(block: Block, a: Automaton, order: int) -> np.ndarray:
    """The sum of the weights of each text.

    All lanes go from left to right together. A lane that begins inside a text first reads the order - 1 tokens
    before, from the root and without counting them: a state remembers no more, so it is then in the state
    in which a single reader would be.
    """
    sizes = np.diff(np.append(block.starts, block.tokens.size))
    lanes = -(-sizes // LANE)
    text = np.repeat(np.arange(sizes.size), lanes)
    offset = (np.arange(text.size) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    first = block.starts[text] + offset
    length = np.minimum(LANE, sizes[text] - offset)
    state, score = np.zeros(text.size, np.int64), np.zeros(text.size)
    for back in range(order - 1, 0, -1):
        on = np.flatnonzero(offset >= back)
        if on.size:
            state[on] = _step(a, state[on], block.tokens[first[on] - back])[1]
    for t in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > t)
        weight, state[on] = _step(a, state[on], block.tokens[first[on] + t])
        score[on] += weight
    return np.bincount(text, score, sizes.size)


def _pack(values: np.ndarray) -> bytes:
    """Numbers by their bytes of equal weight, compressed; small ones take little room."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Hashes by their differences, which are small where they ascend."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


BLOCK_COLUMNS = "block long, n_tokens long, texts binary, tokens binary, hashes binary"


def _deal(block_bytes: int):
    """The texts of a task in blocks, one row each: ids and folds, token numbers, and the tokens' hashes."""

    def packed(slices: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(slices)
        tokens, sizes, hashes = tokenise([t.as_py() or b"" for t in table.column("raw")])
        sink = pa.BufferOutputStream()
        texts = pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "size": pa.array(sizes)})
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(texts)
        block = (TaskContext.get().partitionId() << 32) + number
        row = {"block": block, "n_tokens": tokens.size, "texts": sink.getvalue().to_pybytes(), "tokens": _pack(tokens), "hashes": _pack_keys(hashes)}
        return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("texts", "tokens", "hashes")]]))

    def fn(batches):
        kept, size, number = [], 0, 0
        for batch in batches:
            sizes, first = np.array(pa.compute.binary_length(batch.column("raw")).fill_null(0)) + 16, 0
            for k, n in enumerate(sizes.tolist()):
                size += n
                if size >= block_bytes:
                    yield packed([*kept, batch.slice(first, k + 1 - first)], number)
                    kept, size, number, first = [], 0, number + 1, k + 1
            if first < batch.num_rows:
                kept.append(batch.slice(first))
        if kept:
            yield packed(kept, number)

    return fn


def _unpacked(row: dict, order: int) -> tuple[pa.Table, Block]:
    texts = pa.ipc.open_stream(row["texts"]).read_all()
    return texts, grams(_unpack(row["tokens"]).astype(np.int64), np.array(texts.column("size")), _unpack_keys(row["hashes"]), order)


def _train(table: pa.Table) -> np.ndarray:
    return ~np.array(table.column("held_out").to_pylist(), bool)


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of hashes that ascending keys fall into, and where each begins and the last ends."""
    of = keys >> np.uint64(64 - bits) if bits else np.zeros(keys.size, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if keys.size else np.empty(0, np.int64)
    return of[first].astype(np.int64), np.append(first, keys.size)


def _count(n: int, bits: int):
    """The packed n-grams of order n of each block, one row for each range."""

    def fn(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                texts, block = _unpacked(row, n)
                keys, counts = count(block, _train(texts), n)
                by = np.argsort(keys)
                keys, counts = keys[by], counts[by]
                of, cuts = _ranges(keys, bits)
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of), pa.array(np.full(of.size, row["block"])), pa.array([_pack_keys(keys[a:b]) for a, b in parts], pa.binary()), pa.array([_pack(counts[a:b]) for a, b in parts], pa.binary())],
                    names=["range", "block", "keys", "counts"],
                )

    return fn


def _add(table: pa.Table) -> pa.Table:
    """What the other blocks add to each count of a block's part of the range, in the order of its keys; nothing if all add nothing.

    One more row, of no block, has the range's distinct tokens and the number of all.
    """
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    own = np.concatenate([_unpack(c) for c in table.column("counts").to_pylist()])
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, own).astype(np.uint64)
    others, single = totals[inverse] - own, found & np.uint64(1) == 1
    number = table.column("range")[0].as_py()
    out: list[list] = [[None], [number], [None], [int(np.count_nonzero(totals[single]))], [int(totals[single].sum())]]
    at = 0
    for block, k in zip(table.column("block").to_pylist(), keys, strict=True):
        more = others[at : at + k.size]
        at += k.size
        if more.any():
            for column, value in zip(out, (block, number, _pack(more), None, None), strict=True):
                column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["block", "range", "others", "types", "tokens"])


def _score(order: int, bits: int, tokens: int, types: int, prior: float):
    def fn(blocks: pa.Table, known: pa.Table) -> pa.Table:
        texts, block = _unpacked(blocks.to_pylist()[0], order)
        train, totals = _train(texts), []
        for n in range(1, order + 1):
            keys, amounts = count(block, train, n)
            by = np.argsort(keys)
            of, cuts = _ranges(keys[by], bits)
            own = known.filter(pa.compute.equal(known.column("n"), n))
            for r, others in zip(own.column("range").to_pylist(), own.column("others").to_pylist(), strict=True):
                k = int(np.searchsorted(of, r))
                amounts[by[cuts[k] : cuts[k + 1]]] += _unpack(others).astype(np.int64)
            totals.append(amounts)
        a = build(block, totals, tokens, types, prior)
        sizes = np.diff(np.append(block.starts, block.tokens.size))
        text = np.repeat(np.arange(sizes.size), sizes)
        out = {
            "doc_id": texts.column("doc_id"),
            "held_out": texts.column("held_out"),
            "n_tokens": pa.array(sizes),
            "n_known": pa.array(np.bincount(text, totals[0][block.tokens] > 0, sizes.size).astype(np.int64)),
            "base_score": pa.array(np.bincount(text, a.root_weight[block.tokens], sizes.size)),
            "score": pa.array(traverse(block, a, order)),
        }
        return pa.table(out)

    return fn


def held_out(id_col, folds: int = FOLDS):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(spark: SparkSession, docs: DataFrame, order: int = ORDER, prior: float = PRIOR, folds: int = FOLDS, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """Scores of all ``docs`` (``doc_id, text``) by a model of those outside the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``base_score`` uses
    single tokens alone; ``score`` is the automaton's log10 probability of the text. Null texts are empty: their only
    token is the end. Rows without an id are trained on. Repeated rows count and are scored as often as they stand there, and a text of any
    length is in one block. Other columns are not looked at. An empty table gives no rows; where
    nothing is trained on, every token is unknown. Tokens are told apart by 63 bits of a hash, n-grams of more by 56.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")
    texts = docs.select("doc_id", raw, held_out(F.col("doc_id"), folds).alias("held_out"))
    blocks = materialise(spark, texts.mapInArrow(_deal(block_bytes), BLOCK_COLUMNS), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # each token is the end of one n-gram of each order
    bits = max(0, (int(size) // range_keys).bit_length())
    added = []
    for n in range(1, order + 1):
        # the shuffle files of an order go once its sums are stored, while the next is counted
        counts = blocks.mapInArrow(_count(n, bits), "range long, block long, keys binary, counts binary")
        sums = counts.groupBy("range").applyInArrow(_add, "block long, range long, others binary, types long, tokens long")
        added.append(materialise(spark, sums, f"added-{n}").withColumn("n", F.lit(n)))
    total = added[0].where("block is null").agg(F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    others = reduce(DataFrame.unionByName, added).where("block is not null").select("block", "n", "range", "others")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(_score(order, bits, total.tokens, total.types, prior), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"), "base_score", "score")
