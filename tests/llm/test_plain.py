"""Registered queries on small tables against plain versions of what they do."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from xxhash import xxh64_intdigest

from corvane.llm import paragraphs, quality, queries, urls
from corvane.llm.words import word_hashes

WORDS = [f"w{i}" for i in range(3000)]
MASK = (1 << 64) - 1


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# repeated paragraphs


def mix(x):
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & MASK
    return x ^ (x >> 29)


def plain_cut(text):
    """(number or None, first word, words, whole line) of each paragraph, by the rule word for word."""
    odd, out, number, first = int(paragraphs._ODD[0]), [], 0, 0
    for line in text.lower().split("\n"):
        words = line.split()
        if not words:
            continue
        h = [int(word_hashes(w.encode())[0][0]) for w in words]
        v = [0] + [max(1, mix(h[k] + h[k - 1] * odd & MASK)) for k in range(1, len(h))]
        a = paragraphs.AROUND
        cuts = [0] + [k for k in range(1, len(v)) if k >= a and all(v[k] < v[j] for j in range(k - a, k)) and k + a < len(v) and all(v[k] <= v[j] for j in range(k + 1, k + a + 1))]
        pieces = [(s, e) for s, e in zip(cuts, [*cuts[1:], len(words)], strict=True) if e - s >= paragraphs.SHINGLE]
        for s, e in pieces:
            out.append((number, first + s, words[s:e], (s, e) == (0, len(words))))
            number += 1
        if len(words) >= paragraphs.SHINGLE and pieces != [(0, len(words))]:
            out.append((None, first, words, True))
        first += len(words)
    return out


def keys_of(words):
    c = paragraphs.cut([" ".join(words).encode()])
    k = int(np.flatnonzero(c.whole)[0])
    return c.keys[k].tolist()


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def plain_repeats(docs, run, line_run):
    docs = sorted({d for d in docs if d[1]}, key=lambda d: (d[0] is None, d[0] or 0))
    found = [(d, *p) for d in docs for p in plain_cut(d[1])]
    spaces = {}
    for _, no, _, words, whole in found:
        spaces.setdefault(tuple(words), set()).update({0} if no is not None else set(), {1} if whole else set())
    items = list(spaces)
    keys = {w: {k for s in spaces[w] for k in keys_of(w)[s * 4 : s * 4 + 4]} for w in items}
    group = {w: {w} for w in items}
    for i, a in enumerate(items):
        for b in items[:i]:
            if group[a] is not group[b] and keys[a] & keys[b] and jaccard(a, b) >= 0.8:
                both = group[a] | group[b]
                for w in both:
                    group[w] = both
    occurrences = {}
    for d, no, start, words, whole in found:
        occurrences.setdefault(id(group[tuple(words)]), []).append((docs.index(d), start, start + len(words)))
    kept, firsts = [], {}
    for d, no, start, words, whole in found:
        places = occurrences[id(group[tuple(words)])]
        first = min(places)
        if any(p[0] != q[0] or p[1] >= q[2] for p in places for q in places):
            own = docs.index(d)
            kept.append((own, no, start, len(words), whole, not (own == first[0] and start < first[2]), docs[first[0]][0]))
            firsts[own, start, len(words)] = first
    numbers = {(k[0], k[1]) for k in kept if k[1] is not None}

    def around(own, start, n):
        words = docs[own][1].lower().split()
        return {(tuple(words[at : at + run]), own, at) for at in range(max(0, start + n - run), min(start, len(words) - run) + 1)}

    windows = {}
    for own, no, start, n, *_ in kept:
        if no is not None:
            words = tuple(docs[own][1].lower().split()[start : start + n])
            windows.setdefault(id(group[words]), set()).update(around(own, start, n))
    out = []
    for own, no, start, n, whole, removed, first in kept:
        if no is None:
            ok = n >= line_run
        else:
            low, high = no, no
            while (own, low - 1) in numbers:
                low -= 1
            while (own, high + 1) in numbers:
                high += 1
            total = sum(k[3] for k in kept if k[0] == own and k[1] is not None and low <= k[1] <= high)
            others = windows[id(group[tuple(docs[own][1].lower().split()[start : start + n])])]
            inside = around(own, start, n)
            ok = total >= run or (whole and n >= line_run) or any(w == x and (o, a) != (p, b) for w, o, a in inside for x, p, b in others)
        if ok:
            out.append((docs[own][0], no, start, n, first, removed))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_op1_against_all_pairs(spark, tmp_path, seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    pool = [line(rng.randrange(4, 45)) for _ in range(14)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            t = rng.choice(pool).split() if rng.random() < 0.5 else line(rng.randrange(1, 40)).split()
            if rng.random() < 0.4 and len(t) > 12:
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            parts.append(" ".join(t))
        docs.append((rng.choice([i, i, i, 7, None]), rng.choice(["\n", "\n\n", " "]).join(parts).title()))
    docs += docs[:3] + [(50, None), (51, "")]
    d = stored(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    got = [(r.doc_id, r.paragraph, r.start_word, r.n_words, r.first_doc_id, r.removed) for r in queries.op1_paragraphs(spark, d).collect()]
    want = plain_repeats([(i, t) for i, t in docs], paragraphs.RUN, paragraphs.SHINGLE)
    shown = lambda rows: sorted((r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[3], r[5]) for r in rows)
    assert shown(got) == shown(want) and len(want) > 20


# the others


def test_op7_as_text(spark, tmp_path):
    rows = [(3, "One two three four five"), (1, "ONE two  three four five"), (2, ""), (None, None), (9, "other words here")]
    d = stored(spark, tmp_path, documents=(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, d).collect()}
    hashes = [xxh64_intdigest(s, 42) for s in (b"one two three four", b"two three four five")]
    bits = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 2)
    assert got[1] == got[3] == (f"{bits:016x}", 1) and got[2] == got[None] == ("0" * 16, 2) and got[9][1] == 9


def test_op9_against_its_formula(spark, data, tmp_path):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(400).unionByName(spark.createDataFrame([(900_001, None), (900_002, "")], "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    got = queries.op9_quality(spark, str(tmp_path)).collect()
    model = quality.fit(spark, spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"), labels.select("doc_id", "quality"))
    compressors = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        blocks = [raw[k : k + 1024] for k in range(0, max(1, len(raw)), 1024)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in compressors)
        diff, left = (bad - good) / (bad + good), min(2.0, good / max(1, len(raw)))
        x = [1.0, diff, left, diff * diff, left * left, diff * left]
        score = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert len(got) == 402


def test_op10_against_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)).round(3)
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(200)[:120], v, strict=True)]
    d = stored(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<double>"))
    got: dict = {}
    for r in queries.op10_ann(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, norms = [i for i, _ in rows], np.linalg.norm(v, axis=1)
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        k = ids.index(q)
        cosines = sorted(((-(v[j] @ v[k]) / norms[j] / norms[k], i) for j, i in enumerate(ids) if i != q))[:5]
        assert [i for _, i, _ in sorted(found)] == [i for _, i in cosines] and [s for *_, s in sorted(found)] == pytest.approx([-c for c, _ in cosines])


def test_op6_against_its_trees(spark, tmp_path):
    rng = random.Random(1)
    names = ["casino-win", "free-bets", "shop", "news", "blog-of-me", "cheap-pills", "garden", "trains"]
    rows = [(i, rng.choice([f"https://{rng.choice(names)}{rng.randrange(9)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'es', 'fr'])}/{rng.randrange(999)}?a={rng.randrange(9)}", None, "none"])) for i in range(400)]
    d = stored(spark, tmp_path, pages=(rows, "page_id long, url string"))
    got = {r.page_id: r for r in queries.op6_urls(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet")
    model = urls.fit(pages)
    rates = {r._suffix: r._rate for r in model.suffix_rates.collect()}
    share = lambda text, cs: sum(c in cs for c in text)
    for i, url in rows:
        u = url or ""
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1] if "://" in u else "")
        host, path, n = m[1].lower(), m[2], max(1, len(u))
        labels = host.split(".")
        entropy = -sum(u.count(c) / n * math.log2(u.count(c) / n) for c in set(u))
        alnum = len(re.findall("[A-Za-z0-9]", u))
        x = [len(u), len(host), len(path), path.count("/"), share(u, "0123456789") / n, entropy, u.count("="), len(labels), max(map(len, labels)), host.count("-"), (len(u) - alnum) / n, u.startswith("https:"), rates.get(labels[-1], model.prior)]
        margin = model.base + sum(float(urls.value(t, np.array([x], float))[0]) for t in model.trees)
        score = 1 / (1 + math.exp(-margin))
        fits = [(h + p, verdict) for h, p, verdict in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "block" if score >= 0.5 else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict) and got[i].score == pytest.approx(score, abs=1e-9)
