"""Suffix statistics of the URL filter."""

import zlib

import pytest

from corvane.llm import urls


def test_suffix_rates_are_of_all_training_pages(spark):
    hosts = [f"h{i}.{'rare' if i % 20 == 0 else 'com'}" if i % 3 else f"cheap-casino.{'rare' if i % 20 == 0 else 'com'}" for i in range(900)]
    pages = spark.createDataFrame([(i, f"http://{h}/p{i}") for i, h in enumerate(hosts)], "page_id long, url string")
    model = urls.fit(pages, sample=40)
    train = [h for h in hosts if zlib.crc32(h.encode()) % urls.FOLDS]
    bad = lambda h: h.startswith("cheap")
    prior = (sum(map(bad, train)) + 0.5) / (len(train) + 1)
    assert model.prior == pytest.approx(prior)
    want = {}
    for s in ("rare", "com"):
        mine = [h for h in train if h.endswith("." + s)]
        want[s] = (sum(map(bad, mine)) + 10 * prior) / (len(mine) + 10)
    assert {r._suffix: r._rate for r in model.suffix_rates.collect()} == pytest.approx(want)
    assert urls.judge(pages, model).count() == 900
