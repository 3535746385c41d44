import pytest

from corvane.operators import privacy

DEEP = '{"a": [{"b": {"userCredentials": {"API-Key": 1, "x": [[{"rawContent": null}]]}}}], "Authorization": "x", "fine": 2}'


def test_fields_at_any_depth(spark):
    rows = spark.createDataFrame([(1, DEEP), (2, None), (3, "no json"), (4, "[]"), (5, '"secret"'), (6, "{}"), (7, '[{"secrets": 1}, {"k": {"bearer_token": []}}]')], "id int, body string")
    got = sorted(map(tuple, privacy.sensitive(rows, "id", "body").collect()))
    assert got == [
        (1, "root.member", "authorization_header"), (1, "root.member[0].member.member", "credential"), (1, "root.member[0].member.member.member", "secret"), (1, "root.member[0].member.member.member[0][0].member", "raw_content"),
        (7, "root[0].member", "secret"), (7, "root[1].member.member", "bearer"),
    ]
    assert privacy.fields(rows.where("id > 99"), "id", "body").collect() == []


def test_documents_that_are_too_deep(spark, monkeypatch):
    monkeypatch.setattr(privacy, "DEEPEST", 3)
    with pytest.raises(ValueError, match="deeper"):
        privacy.fields(spark.createDataFrame([(1, "[[[[{}]]]]")], "id int, body string"), "id", "body")


def test_levels_and_forms_of_a_name_are_made_once(spark):
    rows = spark.createDataFrame([(1, DEEP), (2, "[[[1]]]")], "id int, body string")
    plan = privacy.fields(rows, "id", "body")._jdf.queryExecution().executedPlan().toString()
    assert "variant_explode" not in plan and "Generate" not in plan
    plan = rows.select(privacy.category(rows["body"]).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2
