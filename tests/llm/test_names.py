"""Columns of a table keep their values, whatever they are called; extreme ids and vectors."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import ann, decontam, mixing, paragraphs, pii, simhash, urls

NAMES = ("_id", "_n", "_text", "_key", "_bucket", "_cut", "_rest", "_from", "_epochs", "_f", "_score", "_rate", "_suffix", "id", "text_hash", "row", "key", "bucket", "cut", "rest", "from",
         "epochs", "planned", "before", "words", "n", "item", "keys", "component", "part", "label", "found", "score_", "Key", "raw")
WORDS = [f"w{i}" for i in range(4000)]


def table(spark, **columns):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=30)), "ab"[i % 2], *(v[i] for v in columns.values())) for i in range(12)], ", ".join(["doc_id long", "text string", "source string", *columns]))
    names = [n for n in NAMES if n.lower() not in [m.lower() for m in NAMES[: NAMES.index(n)]]]
    return df.withColumns({n: F.col("doc_id") * 100 + k for k, n in enumerate(names)}), names


def values(rows, names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows}


@pytest.mark.parametrize("name", ["mix", "near", "clean", "redact", "quality"])
def test_values_of_clashing_columns(spark, data, name):
    docs, names = table(spark)
    out = {
        "mix": lambda: mixing.mix(spark, docs),
        "near": lambda: simhash.drop_near_duplicates(spark, docs),
        "clean": lambda: decontam.decontaminate(spark, docs, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")),
        "redact": lambda: pii.redact(docs),
        "quality": lambda: corpus_pipeline.keep_good(spark, docs, data),
    }[name]()
    assert out.columns[: len(docs.columns)] == docs.columns
    got, want = values(out.collect(), names), values(docs.collect(), names)
    assert got == {k: want[k] for k in got} and (name == "quality" or len(got) == 12)


def test_values_of_pages_with_clashing_columns(spark):
    docs, names = table(spark, **{"url string": [f"https://x{i}.com/a" for i in range(12)], "page_id long": list(range(12))})
    out = urls.judge(docs, urls.fit(docs))
    assert values(out.collect(), names) == values(docs.collect(), names)


def test_ids_of_any_size(spark):
    line = " ".join(random.Random(3).choices(WORDS, k=40))
    ids = [-(1 << 63), -1, 0, 1 << 62, (1 << 63) - 1, None]
    docs = spark.createDataFrame([(i, line + "\n" + (f"own {i} " * 6)) for i in ids], "doc_id long, text string")
    found = paragraphs.repeats(spark, docs).collect()
    assert {r.doc_id for r in found} == set(ids) and {r.first_doc_id for r in found} == {-(1 << 63)}
    assert {r.doc_id for r in found if not r.removed} == {-(1 << 63)}


def test_vectors_of_any_size(spark):
    rows = [(0, [1e-200, 0.0]), (1, [5e-324, 5e-324]), (2, [1e200, 1e200]), (3, [0.0, -1e308]), (50, [3.0, 4.0]), (4, [3e-160, 4e-160])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(spark, df, df.where("vec_id % 50 = 0")).collect()}
    assert len(got) == 10 and all(-1 - 1e-12 <= s <= 1 + 1e-12 for _, s in got.values())
    assert got[50, 1] == (4, pytest.approx(1.0)) and got[0, 5][0] == 3 and got[0, 5][1] == 0


@pytest.mark.parametrize("kind", ["odd", "empty", "hot"])
def test_stages_of_odd_tables(spark, data, odd, empty, kind):
    hot = spark.createDataFrame([(None, "the same text of ten words in a row here", "s")] * 20 + [(7, None, None)] * 9 + [(7, " ".join(WORDS[:9]), None)], "doc_id long, text string, source string")
    docs = {"odd": odd, "empty": empty, "hot": hot}[kind]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        assert name == "mixing" or out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) <= docs.count() and (kind != "empty" or not rows), name
    if kind == "hot":
        kept = simhash.drop_near_duplicates(spark, hot).collect()
        assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in kept) == [(0, "the"), (7, ""), (7, "w0 ")]
