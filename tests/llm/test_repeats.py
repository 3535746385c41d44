"""Which repeated paragraphs count."""

import random

from corvane.llm import paragraphs, queries

WORDS = [f"w{i}" for i in range(5000)]


def test_repeats_within_one_document(spark):
    rng = random.Random(1)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    block = line(40)
    text = "\n".join([line(20), block, line(20), block, line(20), block, line(20)])
    docs = spark.createDataFrame([(1, text), (2, line(60)), (3, line(30)), (3, line(30))], "doc_id long, text string")
    found = paragraphs.repeats(spark, docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(1, 1)}
    pieces = paragraphs.cut([f"{block}\n{line(20)}".encode()])
    size = int(pieces.words[(pieces.start < 40) & ~pieces.line].sum())
    assert [sum(r.n_words for r in found if r.removed == x and r.paragraph is not None) for x in (False, True)] == [size, 2 * size]
    # equal rows are one document at one place
    assert paragraphs.repeats(spark, spark.createDataFrame([(3, block)] * 2, "doc_id long, text string")).count() == 0


def test_short_repeated_lines_and_passages_inside_lines(spark, tmp_path):
    rng = random.Random(2)
    line = lambda n: " ".join(rng.choices(WORDS, k=n))
    short = [line(n) for n in range(5, 16)]
    rows = [(100 * i + k, f"{line(30)}\n{t}\n{line(30)}") for i, t in enumerate(short) for k in range(2)]
    shared = [line(51) for _ in range(60)]
    rows += [(5000 + 2 * i + k, f"{line(rng.randrange(9, 40))} {t} {line(rng.randrange(9, 40))}") for i, t in enumerate(shared) for k in range(2)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op1_paragraphs(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.start_word, r.n_words, r.removed) for r in found if r.doc_id < 5000}
    assert {(100 * i + k, 30, n, k == 1) for i, n in enumerate(range(5, 16)) for k in range(2)} <= got
    assert len({r.doc_id for r in found if r.doc_id >= 5000}) >= 118
