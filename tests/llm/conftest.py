import pytest

#: Nulls in every column, empty and blank texts, repeated rows and ids, a long text, and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size string, bucket int, item string, fp string, key int, score string, block string, _n int, _id int"


def rows():
    base = [
        (1, "One two three four five six seven.\nAlpha beta gamma.", "a"), (1, "One two three four five six seven.\nAlpha beta gamma.", "a"), (2, None, "a"), (3, "", None),
        (4, " \t\n", "b"), (None, "word", "b"), (None, "word", "b"), (None, None, None), (5, "Ünïcödé ÀÉ 日本語 🦀 mail a@b.co", "c"), (6, "long word " * 20_000, "c"), (7, "x" * 100_000, None),
    ]
    return [(i, t, s, None if k % 2 else "en", len(t or ""), "s", k, "i", "f", k, None, "b", k, k) for k, (i, t, s) in enumerate(base)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
