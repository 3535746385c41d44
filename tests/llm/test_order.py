"""The order of the registered language model."""

from corvane.llm import queries


def test_contexts_of_two_words_count(spark, tmp_path):
    # b follows x as often as d does; only the word before x tells them apart
    rows = [(k, "a x b" if k % 2 else "c x d") for k in range(200)] + [(1000, "a x b"), (1001, "a x d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    scores = {r.doc_id: r.score for r in queries.op2_lm(spark, str(tmp_path)).collect()}
    assert scores[1000] > scores[1001] + 0.5
