"""Byte-pair encoding by speculation: longest matches are proposed, and only what they get wrong is merged.

Each distinct word is cut greedily into its longest tokens. Such a cut is what merging would give
if and only if merging every two neighbours by themselves leaves them as they are: the first merge
across a border would also happen between the two alone. Whether it does is read off their last merges,
undone in the order of time, for all pairs of a batch at once in NumPy. The words that fail are merged exactly.

The vocabulary is a file of the public ``tokenizers`` format: byte-level pieces with a suffix at a word's end, composed and
lower-cased text, words by the file's own pattern. Another kind of file is an error. It is read on the driver and broadcast, so
executors need no copy. Its size bounds what is sent.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.words import mix, powers, slabs

NEVER = np.iinfo(np.int64).max
#: Byte values; a word's last byte is a symbol of its own, this much higher.
BYTES = 256
#: Symbols up to which a word is merged by looking through its pairs each time; longer ones take a heap.
SHORT = 64
#: Bytes of text that are cut into words at once, and one text at least.
SLAB = 3 << 18
#: Words that a Python worker remembers at most in each of two generations, and the longest of them in characters.
KNOWN_WORDS, KNOWN_LENGTH = 3 << 16, 48
# Fixed value: how words are cut.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Table(NamedTuple):
    """Numbers by keys, for many lookups at once: open addressing with a multiplicative hash."""

    slots: np.ndarray
    values: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        bits = max(4, int(2 * keys.size).bit_length())
        table = cls(np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64), 64 - bits)
        at, left = table._first(keys), np.arange(keys.size)
        while left.size:
            free = table.slots[at] < 0
            _, own = np.unique(np.where(free, at, -1), return_index=True)
            own = own[free[own]]  # of several keys for a free slot one gets it
            table.slots[at[own]], table.values[at[own]] = keys[left[own]], values[left[own]]
            rest = np.ones(left.size, bool)
            rest[own] = False
            at, left = (at[rest] + ~free[rest]) & ((1 << bits) - 1), left[rest]
        return table

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._first(keys)
        seen = self.slots[at]
        out = np.where(seen == keys, self.values[at], missing)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while left.size:
            at[left] = (at[left] + 1) & (self.slots.size - 1)
            seen = self.slots[at[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        return out


class Vocabulary(NamedTuple):
    """``results``: the token of each merge by rank. ``left``, ``right`` and ``made``: the last merge of each token and its rank, -1 for single symbols. ``edges``: a trie's, by node and symbol."""

    tokens: list[str]
    pattern: str
    special: dict[str, int]
    atoms: np.ndarray
    ranks: dict[tuple[int, int], int]
    results: list[int]
    pairs: Table
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    edges: Table
    token_at: np.ndarray


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself if it is printable in Latin-1, else the next one free from U+0100 on."""
    printable = [b for b in range(BYTES) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    rest = [b for b in range(BYTES) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(BYTES + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(BYTES)]


def merged(ids: list[int], ranks: dict[tuple[int, int], int], results: list[int]) -> tuple[list[int], list[int], tuple[int, int]]:
    """The tokens after all merges, least rank first and leftmost among equals; the ranks in the order of merging, and the last pair."""
    if len(ids) > SHORT:
        return _merged_by_heap(ids, ranks, results)
    ids, done, last = list(ids), [], (-1, -1)
    open_ = [ranks.get(p, NEVER) for p in pairwise(ids)]
    while open_ and (rank := min(open_)) < NEVER:
        k = open_.index(rank)
        done.append(rank)
        last = ids[k], ids[k + 1]
        ids[k : k + 2] = [results[rank]]
        del open_[k]
        if k:
            open_[k - 1] = ranks.get((ids[k - 1], ids[k]), NEVER)
        if k < len(open_):
            open_[k] = ranks.get((ids[k], ids[k + 1]), NEVER)
    return ids, done, last


def _merged_by_heap(ids: list[int], ranks: dict[tuple[int, int], int], results: list[int]) -> tuple[list[int], list[int], tuple[int, int]]:
    ids, n = list(ids), len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], k) for k, p in enumerate(pairwise(ids)) if p in ranks]
    heapq.heapify(heap)
    done, last = [], (-1, -1)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if j >= n or ranks.get((ids[i], ids[j])) != rank:  # what stood here when the rank was noted is gone
            continue
        done.append(rank)
        last = ids[i], ids[j]
        ids[i], ids[j], after[i] = results[rank], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in ranks:
                heapq.heappush(heap, (ranks[p], k))
    return [t for t in ids if t >= 0], done, last


def merged_together(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``merged`` of many words at once, one merge of each word a round: the word of each token and its id."""
    ids = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    lengths = np.array([len(w) for w in words])
    ids[np.cumsum(lengths) - 1] += BYTES
    ids, word = v.atoms[ids], np.repeat(np.arange(len(words)), lengths)
    size, results, done = len(v.tokens), np.array(v.results), []

    def ranks(at: np.ndarray) -> np.ndarray:
        """Of the pairs that begin at these places."""
        after = np.minimum(at + 1, ids.size - 1)
        return np.where((after > at) & (word[after] == word[at]), v.pairs.get(ids[at] * size + ids[after], NEVER), NEVER)

    rank = ranks(np.arange(ids.size))
    while ids.size:
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        least = np.minimum.reduceat(rank, starts)
        each = np.repeat(least, np.diff(starts, append=ids.size))
        over = each == NEVER
        if over.any():
            done.append((word[over], ids[over]))
            ids, word, rank, each = ids[~over], word[~over], rank[~over], each[~over]
            if not ids.size:
                break
        at = np.flatnonzero(rank == each)
        at = at[np.diff(word[at], prepend=-1) != 0]  # the leftmost of each word
        ids[at] = results[rank[at]]
        stay = np.ones(ids.size, bool)
        stay[at + 1] = False
        at = at - np.arange(at.size)
        ids, word, rank = ids[stay], word[stay], rank[stay]
        rank[at] = ranks(at)
        before = at[(at > 0)] - 1
        rank[before] = ranks(before)
    owner, token = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(owner, kind="stable")
    return owner[order], token[order]


def _checked(spec: dict) -> tuple[str, str]:
    """The word pattern and the suffix of a file that this module can follow."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = before.get("pretokenizers", [])
    fits = (
        model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and model.get("end_of_word_suffix") and steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": PATTERN} and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and spec["decoder"] is None and spec["post_processor"] is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not fits:
        raise ValueError("not a byte-level vocabulary with word ends, composed and lower-cased text and no decoder")
    return cuts[0]["pattern"]["Regex"], model["end_of_word_suffix"]


def read(path: str) -> Vocabulary:
    """The vocabulary of a file, with the last merge of each token and a trie of those tokens that merging can reach."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern, suffix = _checked(spec)
    ids, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (1 + max([*ids.values(), *special.values()]))
    for token, k in (ids | special).items():
        tokens[k] = token
    letters = byte_letters()
    number = {c: b for b, c in enumerate(letters)}
    atoms = np.array([ids[c] for c in letters] + [ids[c + suffix] for c in letters])
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    ranks = {(ids[a], ids[b]): k for k, (a, b) in enumerate(merges)}
    results = [ids[a + b] for a, b in merges]
    size = len(tokens)
    left, right, made, reached = np.full(size, -1), np.full(size, -1), np.full(size, -1), np.zeros(size, bool)
    edges: dict[int, int] = {}
    token_at = [-1]
    for token, k in ids.items():
        end = token.endswith(suffix) and token != suffix
        symbols = [number[c] for c in (token.removesuffix(suffix) if end else token)]
        symbols[-1] += BYTES * end
        out, order, last = merged([int(atoms[s]) for s in symbols], ranks, results)
        if out != [k] or order != sorted(order):  # merging never ends here, or takes a turn that the check can't follow: never proposed
            continue
        reached[k] = True
        if order:
            (left[k], right[k]), made[k] = last, order[-1]
        node = 0
        for s in symbols:
            key = node * 2 * BYTES + s
            if key not in edges:
                edges[key] = len(token_at)
                token_at.append(-1)
            node = edges[key]
        token_at[node] = k
    pairs = Table.of(np.array([a * size + b for a, b in ranks], np.int64), np.array(list(ranks.values()), np.int64))
    trie = Table.of(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64))
    return Vocabulary(tokens, pattern, special, atoms, ranks, results, pairs, left, right, made, trie, np.array(token_at))


def compatible(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether merging the text of two tokens gives just these two, for many pairs at once.

    From the end back, the later one of the two sides' last merges is undone, so that all pairs of pieces that ever meet at
    the border are seen. One that merges before either piece is used up is a merge across the border. Of equal
    ranks the left one comes first.
    """
    good, live = np.ones(left.size, bool), np.arange(left.size)
    x, y = left.astype(np.int64), right.astype(np.int64)
    used_x, used_y = np.full(x.size, NEVER), np.full(x.size, NEVER)
    while live.size:
        rank = v.pairs.get(x * len(v.tokens) + y, NEVER)
        crossed = (rank < used_x) & (rank <= used_y) & (rank < NEVER)
        good[live[crossed]] = False
        made_x, made_y = v.made[x], v.made[y]
        go = ~crossed & (np.maximum(made_x, made_y) >= 0)
        undo_y = made_y >= made_x
        x, used_x, y, used_y = np.where(undo_y, x, v.right[x]), np.where(undo_y, used_x, made_x), np.where(undo_y, v.left[y], y), np.where(undo_y, made_y, used_y)
        live, x, y, used_x, used_y = live[go], x[go], y[go], used_x[go], used_y[go]
    return good


def proposed(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The longest tokens from left to right: the word of each and its id. Words are not empty."""
    symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) for w in words])
    symbols[ends - 1] += BYTES
    length, token = np.zeros(symbols.size, np.int64), np.full(symbols.size, -1)
    live, node, depth = np.arange(symbols.size), np.zeros(symbols.size, np.int64), 0
    while live.size:  # a last byte has no edge after it, so no match leaves its word
        node = v.edges.get(node * 2 * BYTES + symbols[live + depth], -1)
        live, node, depth = live[node >= 0], node[node >= 0], depth + 1
        hit = v.token_at[node] >= 0
        length[live[hit]], token[live[hit]] = depth, v.token_at[node[hit]]
        inside = symbols[live + depth - 1] < BYTES
        live, node = live[inside], node[inside]
    at, word = np.concatenate([[0], ends[:-1]]), np.arange(len(words))
    places, owners = [], []
    while at.size > 32:
        places.append(at)
        owners.append(word)
        at = at + length[at]
        more = at < ends[word]
        at, word = at[more], word[more]
    step = length.tolist() if at.size else []
    for k, w in zip(at.tolist(), word.tolist(), strict=True):  # the last few may be very long
        own, end = [], int(ends[w])
        while k < end:
            own.append(k)
            k += step[k]
        places.append(np.array(own))
        owners.append(np.full(len(own), w))
    places, owners = np.concatenate(places), np.concatenate(owners)
    order = np.lexsort((places, owners))
    return owners[order], token[places[order]]


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[list[bytes], int]:
    """Each word's ids as little-endian 32-bit integers, and how many words had to be merged."""
    owner, ids = proposed(v, words)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    codes, which = np.unique(ids[inner] * len(v.tokens) + ids[inner + 1], return_inverse=True)
    fits = compatible(v, codes // len(v.tokens), codes % len(v.tokens))
    failed = np.unique(owner[inner[~fits[which]]]).tolist()
    out = _packed(owner, ids, len(words))
    short = [k for k in failed if len(words[k]) <= SHORT]
    if short:
        for k, own in zip(short, _packed(*merged_together(v, [words[k] for k in short]), len(short)), strict=True):
            out[k] = own
    atoms = v.atoms.tolist()
    for k in failed:
        if len(words[k]) > SHORT:
            *rest, last = words[k]
            own = merged([*map(atoms.__getitem__, rest), atoms[last + BYTES]], v.ranks, v.results)[0]
            out[k] = struct.pack(f"<{len(own)}I", *own)
    return out, len(failed)


def _packed(owner: np.ndarray, ids: np.ndarray, n: int) -> list[bytes]:
    data, starts = ids.astype("<u4").tobytes(), (4 * np.searchsorted(owner, np.arange(n + 1))).tolist()
    return [data[a:b] for a, b in pairwise(starts)]


class _Known:
    """The ids of words met of late, by two generations, so that what is frequent stays and memory is bounded."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.new, self.old = v, {}, {}

    def get(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        if len(self.new) > KNOWN_WORDS:
            self.new, self.old = {}, self.new
        out = list(map(self.new.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k in missing:
            out[k] = self.old.get(words[k])
        unknown = [k for k in missing if out[k] is None]
        for k, ids in zip(unknown, encode_words(self.v, [words[k] for k in unknown])[0] if unknown else [], strict=True):
            out[k] = ids
        self.new.update((words[k], out[k]) for k in missing if len(words[k]) <= KNOWN_LENGTH)
        return out


#: Kinds of characters; the last one is of those that Python's Unicode tables don't know, as they may be older than the library's.
SPACE, LETTER, DIGIT, OTHER, NEWER = range(5)


@cache
def kinds() -> np.ndarray:
    """The kind of each code point."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[[unicodedata.category(c) == "Cn" for c in every]] = NEWER
    return np.concatenate([out[:0xD800], np.full(0x800, OTHER, np.uint8), out[0xD800:]])


def pieces(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, as ``PATTERN`` finds them: runs of letters, single digits, runs of other characters, and seven endings after an apostrophe."""
    before = np.concatenate([[SPACE], kind[:-1]])
    first = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
    at = np.flatnonzero(first & (points == ord("'")))
    if at.size:  # an apostrophe alone between other kinds, before letters
        after = lambda k: np.where(at + k < points.size, points[np.minimum(at + k, points.size - 1)], 0)
        one = np.isin(after(1), [ord(c) for c in "stmd"])
        two = np.isin(after(1) * 0x110000 + after(2), [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")])
        for found, n in ((one, 2), (two & ~one, 3)):
            own = at[found]
            first[own + 1] = False
            rest = own + n
            rest = rest[rest < points.size]
            first[rest[kind[rest] == LETTER]] = True
    start = np.flatnonzero(first)
    ends = np.flatnonzero((kind != SPACE) & np.concatenate([kind[1:] == SPACE, [True]])) + 1
    # a word ends where the next one begins, or at white space before that
    end = np.concatenate([start[1:], [points.size]])
    stop = ends[np.searchsorted(ends, start, "right")] if start.size else ends[:0]
    return start, np.minimum(end, stop)


class Encoder:
    """A vocabulary with the words met so far, for one Python worker."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.known, self.cut = v, _Known(v), regex.compile(v.pattern).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=lambda s: (-len(s), s))) + ")") if v.special else None

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, by the library's own tables if Python's don't know some character."""
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            from tokenizers import Regex, normalizers, pre_tokenizers

            text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
            return [w for w, _ in pre_tokenizers.Split(Regex(self.v.pattern), "removed", invert=True).pre_tokenize_str(text)]
        return self.cut(_normal(text))

    def _apart(self, text: str) -> np.ndarray:
        """The ids of one text, word by word: for texts with special tokens or characters newer than Python's tables."""
        parts = []
        for k, segment in enumerate(self.special.split(text) if self.special else [text]):
            parts += [struct.pack("<I", self.v.special[segment])] if k % 2 else self.known.get([w.encode() for w in self.words(segment)])
        return np.frombuffer(b"".join(parts), "<u4").astype(np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Words are cut out, told apart and put together for all texts at once."""
        apart = [self.special is not None and "<" in t and bool(self.special.search(t)) for t in texts]
        plain = ["" if out else _normal(t) for t, out in zip(texts, apart, strict=True)]
        lengths = np.array([len(t) + 1 for t in plain])
        points = np.frombuffer("\n".join([*plain, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        kind, ends = kinds()[points], np.cumsum(lengths)
        newer = np.flatnonzero(kind == NEWER)
        if newer.size:
            for k in np.unique(np.searchsorted(ends, newer, "right")).tolist():
                apart[k] = True
            kind = np.where(kind == NEWER, OTHER, kind)  # of texts that are encoded apart
        start, end = pieces(points, kind)
        token, count = self._tokens("\n".join([*plain, ""]).encode(), points, start, end)
        bounds = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, np.concatenate([[0], ends]))].tolist()
        return [self._apart(t) if out else token[a:b] for t, out, (a, b) in zip(texts, apart, pairwise(bounds), strict=True)]

    def _tokens(self, text: bytes, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        if not start.size:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(text) != points.size:  # to places in bytes
            place = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
            start, end = place[start], place[end]
        data, size = np.frombuffer(text, np.uint8), end - start
        base, back = powers(data.size)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * base[: data.size], dtype=np.uint64)])
        hashed = mix((sums[end] - sums[start]) * back[start])
        _, one, which = np.unique(hashed, return_index=True, return_inverse=True)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = np.array_equal(size, size[one[which]]) and np.array_equal(data[np.repeat(start, size) + within], data[np.repeat(start[one[which]], size) + within])
        if not same:  # two words of one hash
            one = which = np.arange(start.size)
        known = self.known.get([text[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)])
        ids, length = np.frombuffer(b"".join(known), "<u4").astype(np.int32), np.array([len(k) // 4 for k in known])
        count = length[which]
        first = (np.cumsum(length) - length)[which]
        return ids[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())], count


def _normal(text: str) -> str:
    """Composed and in lower case, letter by letter, so without a final form of sigma."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_encoders: list[Encoder] = []


def _encoder(v: Vocabulary) -> Encoder:
    """The worker's encoder; a worker has a broadcast value once, so another vocabulary is another object."""
    if not _encoders or _encoders[0].v is not v:
        _encoders[:] = [Encoder(v)]
    return _encoders[0]


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary of a file that the driver can read, for ``encode`` and ``decode``."""
    return spark.sparkContext.broadcast(read(path))


def encode(text: Column, vocabulary: Broadcast) -> Column:
    """The ids of a text, special tokens written in it included, as ``array<int>``.

    Whole texts are encoded, however long. Null texts are empty, and texts without words have no ids. Equal texts have equal ids.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encoded(texts: pa.Array) -> pa.Array:
        encoder, parts = _encoder(vocabulary.value), []
        for _, group in slabs(texts, SLAB):
            parts += encoder.encode([t.decode() for t in group])
        offsets = np.cumsum([0] + [p.size for p in parts])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))

    return encoded(F.coalesce(text, F.lit("")).cast("binary"))


def _lists(rows: pa.ListArray, below: int = 1 << 32) -> tuple[np.ndarray, np.ndarray]:
    """All ids from 0 to below a bound, and where each row's begin; null rows have none."""
    flat, lengths = rows.flatten(), rows.value_lengths().fill_null(0).to_numpy()
    values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
    good = (values >= 0) & (values < below)
    if not good.all():
        lengths = np.diff(np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(lengths)])])
    return values[good], np.concatenate([[0], np.cumsum(lengths)])


def decode(ids: Column, vocabulary: Broadcast) -> Column:
    """The tokens of ``array<int>`` ids, special ones included, with a blank between two: the file names no decoder. Null ids or ids of no token give nothing."""

    @F.arrow_udf(T.StringType())
    def decoded(rows: pa.Array) -> pa.Array:
        spelled = _spelled(vocabulary.value)
        values, starts = _lists(rows, len(spelled))
        out = []
        for a, b in pairwise(starts.tolist()):
            # what is taken lies in one buffer, each token with a blank after it
            _, ends, data = spelled.take(pa.array(values[a:b])).buffers()
            out.append(data[: int(np.frombuffer(ends, np.int32)[b - a])].to_pybytes()[:-1] if b > a else b"")
        return pa.array(out, pa.binary()).cast(pa.string())

    return decoded(ids)


_spellings: list[tuple[Vocabulary, pa.StringArray]] = []


def _spelled(v: Vocabulary) -> pa.StringArray:
    if not _spellings or _spellings[0][0] is not v:
        _spellings[:] = [(v, pa.array([t + " " if t else "" for t in v.tokens], pa.string()))]
    return _spellings[0][1]


def packed(ids: Column) -> Column:
    """``array<int>`` ids as little-endian unsigned 32-bit integers; null ids give nothing."""

    @F.arrow_udf(T.BinaryType())
    def bytes_of(rows: pa.Array) -> pa.Array:
        values, starts = _lists(rows)
        data = values.astype("<u4").tobytes()
        return pa.array([data[4 * a : 4 * b] for a, b in pairwise(starts.tolist())], pa.binary())

    return bytes_of(ids)
