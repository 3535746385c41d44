"""SimHash groups and repeated paragraphs, and what they are built on."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from corvane.llm import blocking, components, paragraphs, simhash

WORDS = [f"w{i}" for i in range(5000)]


def plain_components(links):
    seen: dict = {}
    for a, b in links:
        for x in (a, b):
            seen.setdefault(x, {x})
        if seen[a] is not seen[b]:
            joined = seen[a] | seen[b]
            for x in joined:
                seen[x] = joined
    return {x: min(s) for x, s in seen.items()}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(-50, 300), rng.randrange(-50, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 80)]
    df = spark.createDataFrame([*links, *links[:9], (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(spark, df).collect()}
    assert got == plain_components([(a, b) for a, b in links if a != b])
    assert components.connected_components(spark, df.limit(0)).count() == 0


def test_spanning_links_reach_every_component():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 400, 150)
    links = blocking.spanning_links(x.size, lambda i, others: abs(x[others] - x[i]) <= 2)
    plain = plain_components([(i, j) for i in range(150) for j in range(i) if abs(x[i] - x[j]) <= 2])
    assert plain_components(links) == plain and len(links) < 150


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius in (1, 3, 4):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flips = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & flips == 0 for m in masks)


def near_copies(rng, n=60):
    base = [rng.choice(WORDS) for _ in range(400)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(400)] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [8192, 4])
def test_simhash_against_all_pairs(spark, odd, block):
    rng = random.Random(block)
    texts = near_copies(rng) + near_copies(rng, 20) + [" ".join(rng.choices(WORDS, k=50)) for _ in range(30)]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = odd.select("doc_id", "text", "fp", "bucket").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    given = docs.collect()
    got = simhash.near_duplicates(spark, docs, block=block).collect()
    prints = [plain_fingerprint(r.text) for r in given]
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got) == sorted((r.doc_id or -1, p) for r, p in zip(given, prints, strict=True))
    links = [(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 4]
    group = plain_components(links)
    least: dict = {}
    for r, p in zip(given, prints, strict=True):
        if r.doc_id is not None:
            least[group[p]] = min(least.get(group[p], r.doc_id), r.doc_id)
    want = sorted((r.doc_id or -1, least.get(group[p]) or -1) for r, p in zip(given, prints, strict=True))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == want


def test_one_document_of_each_group_stays(spark, odd, empty):
    kept = simhash.drop_near_duplicates(spark, odd)
    assert kept.columns == odd.columns
    # empty and blank texts are one group; repeated rows and ids are one document
    assert sorted((r.doc_id or -1, (r.text or "")[:4]) for r in kept.collect()) == [(-1, "word"), (1, "One "), (2, ""), (5, "Ünïc"), (6, "long"), (7, "xxxx")]
    assert simhash.drop_near_duplicates(spark, empty).count() == simhash.near_duplicates(spark, empty).count() == 0


def passages(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def test_passages_are_found_wherever_they_stand(spark, odd):
    rng = random.Random(5)
    shared = [passages(rng, 60) for _ in range(20)]
    rows, planted = [], {}
    for i in range(120):
        text = passages(rng, 150)
        if i < 80:
            at = rng.randrange(150)
            words = text.split()
            text = " ".join([*words[:at], shared[i % 20], *words[at:]])
            planted[i] = i % 20
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeats(spark, docs).collect()
    assert {r.doc_id for r in found} == set(planted)
    for r in found:
        assert planted[r.first_doc_id] == planted[r.doc_id] and r.removed == (r.doc_id != r.first_doc_id)
    assert paragraphs.repeats(spark, docs, block=3).count() == len(found)


def similar_pairs(rng):
    """Pairs of lines of 13 words that aren't cut and differ in the last word: 8 of 10 shingles are common."""
    while True:
        words = rng.choices(WORDS, k=12)
        a, b = (" ".join([*words, w]) for w in rng.sample(WORDS, 2))
        ca, cb = paragraphs.cut([a.encode()]), paragraphs.cut([b.encode()])
        if ca.start.size == cb.start.size == 1 and ca.words[0] == cb.words[0] == 13:
            yield a, b, bool(set(ca.keys.ravel().tolist()) & set(cb.keys.ravel().tolist()))


def test_similar_paragraphs_are_one_class(spark):
    pairs = similar_pairs(random.Random(6))
    lines = [next(p for p in pairs if p[2])[:2] for _ in range(6)]
    rows = [(10 * i + k, text) for i, pair in enumerate(lines) for k, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = paragraphs.repeats(spark, docs, run=13).collect()
    assert sorted((r.doc_id, r.removed, r.first_doc_id) for r in found) == [(d, d % 10 == 1, d // 10 * 10) for d, _ in rows]
    assert len({r.class_id for r in found}) == 6 and paragraphs.repeats(spark, docs, similar=0.85, run=13).count() == 0


def test_bands_have_the_recall_they_are_tuned_for():
    pairs = similar_pairs(random.Random(8))
    assert sum(next(pairs)[2] for _ in range(400)) >= 380


def test_cut_is_the_same_in_any_context():
    rng = random.Random(7)
    passage = passages(rng, 80).encode()
    cuts = []
    for _ in range(20):
        text = passages(rng, rng.randrange(5, 60)).encode() + b" " + passage + b" " + passages(rng, 40).encode()
        c = paragraphs.cut([text])
        cuts.append(set(c.content.tolist()))
        start, words = c.start[~c.line], c.words[~c.line]
        assert (start[1:] >= (start + words)[:-1]).all() and (c.words >= 5).all()
    assert len(set.intersection(*cuts)) >= 3


def test_odd_tables(spark, odd, empty):
    assert paragraphs.repeats(spark, empty).count() == 0
    assert paragraphs.repeats(spark, odd).count() == 0
    twice = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    assert {r.doc_id for r in paragraphs.repeats(spark, twice).collect()} == {6, 106}
