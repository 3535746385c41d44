"""Byte pairs, vector codes and periodic runs through their registered queries, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import bpe, codes, periodic, queries
from corvane.llm.sql import oracle_sql

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read(PATH)


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# byte pairs

ODD_TEXTS = [
    None, "", " \t\n\x0b", "It's I'LL we've 'd 's", "<|startoftext|>Hi<|endoftext|><|endoftext|> <|endofText|>", "ΑΣ Σ ΟΔΟΣ İ ẞ ﬁ é ẛ̣", "日本語 русский 🦀👨‍👩‍👧 ½ Ⅳ ١٢", "a\x00b\x1c\x85\xa0　c",
    "Ᲊ \U00011382\U000113c9 ꟎ Ꟛ", "x" * 100_000, "ab" * 30_000, "!" * 5_000, "the quick brown fox " * 60_000, "unbelievably reformulated tokenisation isn't hahahaha",
]


def test_bpe_equals_the_library(spark, data, tmp_path, vocabulary):
    rng = random.Random(5)
    letters = "abcdeinorstuABé' ’0129.,!<|>_\n"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    ids = [k if k % 50 else None for k in range(len(texts))] + [7]
    folder = written(spark, tmp_path, "documents", list(zip(ids, [*texts, texts[7]], ["en"] * len(ids), strict=True)), "doc_id long, text string, ids string")
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()

    def wanted(text):
        found = library.encode(text or "", add_special_tokens=False).ids
        return len(found), sha(np.array(found, "<u4").tobytes()), sha(library.decode(found, skip_special_tokens=False))

    got = queries.op11_bpe(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((i, *wanted(t)) for i, t in zip(ids, [*texts, texts[7]], strict=True)), key=repr)


def test_bpe_empty_table(spark, tmp_path):
    assert queries.op11_bpe(spark, written(spark, tmp_path, "documents", [], "doc_id long, text string")).collect() == []


def test_pairs_are_compatible_if_merging_leaves_them(vocabulary):
    rng = np.random.default_rng(1)
    v, n = vocabulary, 3000
    suffix = np.array([t.endswith("</w>") for t in v.tokens])
    left, right = (rng.choice(np.flatnonzero(x & (np.arange(suffix.size) < 49_406)), n) for x in (~suffix, np.ones(suffix.size, bool)))
    common = np.flatnonzero(~suffix & (np.arange(suffix.size) < 2_000))
    left[: n // 2], right[: n // 2] = rng.choice(common, n // 2), rng.choice(common, n // 2)
    letter = {c: b for b, c in enumerate(bpe.byte_letters())}

    def atoms(token):
        text = v.tokens[token]
        symbols = [letter[c] for c in text.removesuffix("</w>")]
        symbols[-1] += bpe.BYTES * text.endswith("</w>")
        return [int(v.atoms[s]) for s in symbols]

    plain = [bpe.merged(atoms(a) + atoms(b), v.ranks, v.results)[0] == [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert bpe.compatible(v, left, right).tolist() == plain and 0 < sum(plain) < n


def test_only_what_speculation_gets_wrong_is_merged(vocabulary):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randint(1, 12))).encode() for _ in range(500)]
    packed, failed = bpe.encode_words(vocabulary, words)
    owner, ids = bpe.proposed(vocabulary, words)
    wrong = sum(ids[owner == k].astype("<u4").tobytes() != packed[k] for k in range(len(words)))
    assert 0 < failed == wrong < len(words)


@pytest.mark.parametrize("size", [3, 40, 65, 300])
def test_both_ways_of_merging_agree(vocabulary, size):
    rng = random.Random(size)
    for letters in ("ab", "aeinrst", "xyzq0!"):
        ids = [int(vocabulary.atoms[ord(rng.choice(letters))]) for _ in range(size)]
        plain = list(ids)
        while ranks := [(vocabulary.ranks[p], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in vocabulary.ranks]:
            rank, k = min(ranks)
            plain[k : k + 2] = [vocabulary.results[rank]]
        assert bpe.merged(ids, vocabulary.ranks, vocabulary.results)[0] == plain
        assert bpe._merged_by_heap(ids, vocabulary.ranks, vocabulary.results)[0] == plain


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.read(public_tokenizers.path("byte_bpe_50k.json"))


def test_decoding_ignores_what_is_no_token(spark, vocabulary):
    shared = bpe.share(spark, PATH)
    rows = spark.createDataFrame([([320, 49_407, 99_999, -1, None, 320],), (None,), ([],)], "ids array<int>")
    word = vocabulary.tokens[320]
    assert [r[0] for r in rows.select(bpe.decode(rows.ids, shared)).collect()] == [f"{word} <|endoftext|> {word}", "", ""]


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    first = {}
    for i, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        first.setdefault(i, v)
    first = list(first.values())[:entries]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def nearest(book, part):
        d = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                part = v[p * width : (p + 1) * width]
                own[nearest(books[p], part)[0]].append(part)
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, lab, v in kept:
        found = [nearest(books[p], v[p * width : (p + 1) * width]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
        by_label[lab] += out[-1][3]
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return sorted(((i, c, e, by_label[lab], digest) for i, lab, c, e in out), key=repr)


def vectors(n, dims, seed):
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, rng.choice([None, "a", "b"]), list(rng.choice(base)) if rng.random() < 0.4 else [rng.choice([-0.5, 0.25, rng.uniform(-2, 2)]) for _ in range(dims)]) for i in range(n)]
    for v in (None, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [None] + [0.0] * (dims - 1)):
        rows.append((len(rows), "a", v))
    return [*rows, rows[3], rows[3], (None, "b", rows[4][2]), (5, None, [0.125] * dims)]


@pytest.mark.parametrize(("n", "dims"), [(120, 16), (7, 8), (60, 64)])
def test_codes_are_those_of_plain_lloyd(spark, tmp_path, n, dims):
    rows = vectors(n, dims, n)
    random.Random(1).shuffle(rows)
    frame = [(i, lab, v, "x", 3) for i, lab, v in rows]
    folder = written(spark, tmp_path, "embeddings", frame, "vec_id long, label string, embedding array<double>, code string, error long")
    got = queries.op12_codes(spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)


def test_codes_of_frequent_parts_are_joined_by_broadcast(spark):
    """With few rows a share, both joins have work to do."""
    rows = spark.createDataFrame([(k % 7 if k % 3 else None, k) for k in range(100)], "label int, k int")
    sums = rows.groupBy("label").agg({"k": "sum", "*": "count"}).withColumnRenamed("count(1)", "weight").withColumnRenamed("sum(k)", "s")
    got = codes.joined_by_share(rows, sums, ["label"], 100, shares=8)
    plain = defaultdict(int)
    for r in rows.collect():
        plain[r.label] += r.k
    assert sorted((r.k, r.s) for r in got.collect()) == sorted((r.k, plain[r.label]) for r in rows.collect())


def test_codes_refuse_what_has_no_exact_result(spark):
    schema = "vec_id long, label int, v array<double>"
    for bad in ([(1, 1, [0.0] * 8), (2, 1, [0.0] * 16)], [(1, 1, [0.0] * 9)], [(1, 1, [1e300] + [0.0] * 7)], [(1, 1, [2.0**17] + [0.0] * 7)]):
        with pytest.raises(ValueError, match="vectors"):
            codes.compress(spark, spark.createDataFrame(bad, schema))
    for rows in ([], [(1, 1, None)]):
        assert codes.compress(spark, spark.createDataFrame(rows, schema))[0].collect() == []


def test_codes_sql_covers_odd_rows(spark, tmp_path):
    import duckdb

    rows = [r for r in vectors(90, 16, 2) if r[0] is not None]
    folder = written(spark, tmp_path, "embeddings", rows, "vec_id long, label string, embedding array<float>")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    got = queries.op12_codes(spark, folder)
    order = ", ".join(got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(f"SELECT {order} FROM ({oracle_sql()['op12_codes']})").fetchall()))


# periodic runs


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    digest, rest = sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(b" ".join(w for k, w in enumerate(words) if k not in gone))
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, rest)


def made_text(rng):
    kinds = rng.choice([1, 2, 3, 60])
    words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 250))]
    for _ in range(rng.randint(0, 3)):
        p = rng.randint(1, 30)
        unit = [f"w{rng.randrange(kinds + 1)}" for _ in range(p)]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 12)[: rng.randint(1, 12 * p)]
    return rng.choice([" ", "\n", "\t \x0b"]).join(words)


def test_runs_are_those_of_a_plain_search(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, made_text(rng)) for k in range(400)]
    rows += [(None, "a " * 40), (1, None), (2, ""), (3, " \n"), (4, " a\x85b c " * 30), (5, "x" * 200_000), rows[0], rows[0], (None, None), (6, "ä 日本 " * 20)]
    folder = written(spark, tmp_path, "documents", [(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, start int")
    got = queries.op13_periodic(spark, folder)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == sorted((plain_row(*r) for r in rows), key=repr)
    assert sum(r[1] for r in found) > 100


def test_runs_of_an_empty_table(spark, tmp_path):
    assert queries.op13_periodic(spark, written(spark, tmp_path, "documents", [], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(("words", "wanted"), [
    ([b"x"] * 300_000, [(0, 300_000, 1)]),
    ([b"%d" % (k % 70_001) for k in range(300_000)], [(0, 300_000, 70_001)]),
    ([b"%d" % k for k in range(200_000)], []),
])
def test_runs_of_very_long_texts(words, wanted):
    assert [tuple(map(int, r)) for r in zip(*periodic.runs([words]), strict=True)] == wanted


def test_no_run_goes_from_one_text_to_the_next():
    start, length, period = periodic.runs([[b"a"] * 20, [b"a"] * 20, [b"a"] * 24, []])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([40], [24], [1])
