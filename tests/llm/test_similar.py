"""Near duplicates of the pipeline, by exact similarity of five-word shingles."""

import random

import numpy as np

from corvane.llm import similar, simhash

WORDS = [f"w{i}" for i in range(5000)]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def copies(rng, n):
    """Texts of 100 words with one of similarity 0.8 or more, and with one below it."""
    for _ in range(n):
        words = rng.choices(WORDS, k=100)
        near, far = list(words), list(words)
        for at in (20, 60):
            near[at] = rng.choice(WORDS) + "x"
        for at in (10, 40, 70):
            far[at] = rng.choice(WORDS) + "x"
        yield tuple(" ".join(w) for w in (words, near, far))


def test_copies_of_similarity_0_8_go_and_others_stay(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for k, (text, near, far) in enumerate(copies(rng, 40)):
        assert jaccard(text, near) >= 0.8 > jaccard(text, far)
        rows += [(10 * k, text), (10 * k + 1, near if k % 2 else far)]
        want |= {10 * k} if k % 2 else {10 * k, 10 * k + 1}
    # more than four bits apart, which the fingerprints of op7 don't link
    assert any((simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > 4 for (_, a), (_, b) in zip(rows[2::4], rows[3::4], strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.drop_near_duplicates(spark, docs).collect()]
    assert sorted(kept) == sorted(want)


def test_bands_miss_no_pair_at_the_threshold():
    rng = random.Random(2)
    hit = 0
    for text, near, _ in copies(rng, 300):
        a, b = (set(similar.bands(similar.shingles(t.encode())[1]).tolist()) for t in (text, near))
        hit += bool(a & b)
    assert hit == 300


def test_texts_of_few_words_link_only_if_equal(spark):
    texts = ["a b", "A  b\n", "a b c", "", None, "b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(spark, docs).collect()) == [0, 2, 3, 5]
    assert np.unique(similar.shingles(b"")[1]).size == 1


def test_unrelated_texts_of_one_id_stay(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=30)) for _ in range(20)]
    rows = [(7, t, "a") for t in texts] + [(7, texts[0], "b"), (8, texts[1], "a"), (3, texts[2], "a")]
    kept = simhash.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(7, t) for k, t in enumerate(texts) if k != 2] + [(3, texts[2])])


def test_the_covering_brings_together_all_within_its_radius(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(4), []
    for k in range(30):
        words = rng.choices(WORDS, k=400)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], "other"]))]
    texts = spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    # without bands, so that only fingerprints bring texts together
    items = similar.itemised(texts, simhash.fingerprint).withColumn("keys", F.array().cast("array<long>")).cache()
    prints = {r.id: (r.item, r.fp & (1 << 64) - 1) for r in items.collect()}
    assert all(prints[i][1] == simhash.fingerprint(t.encode(), similar.SHINGLE) for i, t in rows)
    sharing = {}
    for r in similar.buckets(items, simhash.covering(4)).collect():
        sharing.setdefault(r.item, set()).add(r.bucket)
    near = [(a, b) for k in range(30) for (a, x), (b, y) in [(prints[2 * k], prints[2 * k + 1])] if (x ^ y).bit_count() <= 4]
    assert len(near) > 20 and all(len(sharing[a]) == 31 and sharing[a] & sharing[b] for a, b in near)
