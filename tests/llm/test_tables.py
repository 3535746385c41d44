"""URL filters, mixing, nearest neighbours, the pipeline, and the registered queries."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import ann, mixing, queries, sql, urls

# URLs


def plain_url(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


ODD_URLS = [None, "", "no scheme", "http://", "://x.com/", "HTTP://WWW.Example.COM/en/1?a=b#c", "https://a.example.com/en/", "https://example.com/en", "http://x.net/es/?q", "http://net/fr/x",
            "http://xcom/", "http://x.com?y/z", "http://ü.ÄB.com/Ä", "ftp://a.com/b://c", "http://a.b.net\n/es/", "http://" + "a" * 50_000 + ".com/" + "b/" * 9000]


def test_hosts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(ODD_URLS)], "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in urls.judge(pages, urls.fit(pages)).collect()}
    for i, u in enumerate(ODD_URLS):
        host, path, rule, verdict = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert urls.judge(pages.limit(0), urls.fit(pages.limit(0))).count() == 0


def test_trees_generalise_to_held_out_pages(spark, data):
    pages = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/pages.parquet").select("page_id", "url")
    right = total = caught = unwanted = 0
    for fold in range(urls.FOLDS):
        # each host is judged by trees that have seen none of its pages
        out = urls.judge(pages, urls.fit(pages, fold=fold)).withColumn("y", urls.labelled(F.col("host"))).where(urls.held_out(F.col("host"), fold)).collect()
        right, total = right + sum((r.score >= 0.5) == (r.y == 1) for r in out), total + len(out)
        caught, unwanted = caught + sum(r.score >= 0.5 and r.y == 1 for r in out), unwanted + sum(r.y for r in out)
    assert total == pages.count() and right >= 0.97 * total and caught >= 0.5 * unwanted > 0, (right, total, caught, unwanted)
    plan = urls.judge(pages, urls.fit(pages))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_trees_as_conditions_equal_the_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(urls.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    base, trees = urls.fit_trees(x, y)
    margin = base + sum(urls.value(t, x) for t in trees)
    assert ((margin > 0) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:50])], ["i", *urls.FEATURES]).withColumn("_f", F.struct(*urls.FEATURES))
    total = F.lit(base)
    for t in trees:
        total = total + urls._expression(t)
    assert [r.m for r in df.orderBy("i").select(total.alias("m")).collect()] == pytest.approx(margin[:50].tolist())


# mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(target.values())
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > most * sizes[s]]
        if not over:
            break
        target |= {s: most * sizes[s] for s in over}
        free -= set(over)
    rest = total - sum(target.values())
    return target | {s: rest * w[s] / sum(w[x] for x in free) for s in free}


def test_mixing_against_water_filling(spark, odd, empty):
    rng = random.Random(2)
    rows = [(100 + i, "w " * rng.randrange(40), rng.choice(["hot"] * 6 + ["b", "é", "z", "B", None])) for i in range(600)]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string"), allowMissingColumns=True)
    out = mixing.mix(spark, docs)
    assert [c for c in docs.columns if c != "size"] == [c for c in out.columns if c not in ("size", "source_size", "target", "taken")]
    got = out.collect()
    sizes: dict = {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
    want = plain_targets(sizes)
    assert len(got) == docs.count()
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and all(abs(r.target - want[s]) < 1e-5 for r in mine)
        assert sum(r.taken for r in mine) == math.floor(mine[0].target) and all(0 <= r.taken <= 2 * r.size for r in mine)
        # within an epoch at most one document is taken in part
        assert sum(bool(r.size and r.taken % r.size) for r in mine) <= 1 or len({(r.doc_id, r.size) for r in mine}) < len(mine)
    again = mixing.mix(spark, docs.repartition(7)).collect()
    key = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert key(again) == key(got)
    assert mixing.mix(spark, empty).count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


# nearest neighbours


def nearest(ids, v, q, k):
    n = np.sqrt((v * v).sum(1))
    s = (v * v[q]).sum(1) / n / n[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [(int(ids[i]), s[i]) for i in order[:k]]


@pytest.mark.parametrize("block", [100_000, 400])
def test_neighbours(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 32))
    v = (centres[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, 32))).astype(np.float32)
    v[100:400] = v[7]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(9000, None), (9050, []), (9100, [0.0] * 32), (9150, [float("nan")] + [1.0] * 31), (9200, [float("inf")] * 32), (9250, [None] + [1.0] * 31), (9300, [1.0, 2.0]), (None, [1.0] * 32)]
    df = spark.createDataFrame(rows + bad, "vec_id long, v array<float>")
    got: dict = {}
    for r in ann.nearest(spark, df, df.where("vec_id % 50 = 0"), block=block, chunk=17).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids, x, hit, total = np.arange(2000), v.astype(np.float64), 0, 0
    assert set(got) == set(range(0, 2000, 50))
    for q, found in got.items():
        want = nearest(ids, x, q, 5)
        assert sorted(found) == [1, 2, 3, 4, 5]
        hit += len({a for a, _ in want} & {a for a, _ in found.values()})
        total += 5
        assert all(abs(s - (x[a] @ x[q]) / np.linalg.norm(x[a]) / np.linalg.norm(x[q])) < 1e-12 for a, s in found.values())
    assert hit >= 0.9 * total
    # of equal vectors the smallest ids answer, without the query's own
    assert [got[150][k][0] for k in range(1, 6)] == [7, 100, 101, 102, 103] and [got[100][k][0] for k in range(1, 6)] == [7, 101, 102, 103, 104]


def test_few_or_no_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, v array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(spark, df, df.where("vec_id % 50 = 0")).collect())
    assert got == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert ann.nearest(spark, df.limit(0), df).count() == ann.nearest(spark, df, df.limit(0)).count() == 0


# pipeline and queries


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() <= before and out.select("doc_id").distinct().count() == out.count(), name
        docs, before = out, out.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert mixed and all(0 < r.taken <= 2 * r.size for r in mixed)


def test_whole_pipeline_and_registry(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)] and set(sql.oracle_sql()) <= set(queries.queries())
