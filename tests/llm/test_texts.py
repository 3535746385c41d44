"""Operators that look at each text: language model, licences, personal data, decontamination, quality."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontam, licenses, lm, pii, quality, queries

WORDS = [f"w{i}" for i in range(3000)]


# language model


@pytest.mark.parametrize(("order", "block_bytes", "range_keys"), [(1, 10**9, 10**9), (2, 2000, 50), (3, 700, 100)])
def test_language_model_against_a_dictionary(spark, odd, order, block_bytes, range_keys):
    rng = random.Random(order)
    rows = [(100 + i, " ".join(rng.choices("a b c d E f".split(), k=rng.choice([0, 1, 5, 700])))) for i in range(60)]
    docs = odd.where("coalesce(doc_id, 0) not in (6, 7)").select("doc_id", "text", "key", "block").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    given = docs.collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["<end>"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts: Counter = Counter()
    for r in given:
        if not held(r.doc_id):
            w = tokens(r.text)
            counts.update(tuple(w[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(w)))
    n, v = sum(c for k, c in counts.items() if len(k) == 1), sum(len(k) == 1 for k in counts)

    def p(context, word):
        if not context:
            return (counts[(word,)] + 0.1) / (n + 0.1 * (v + 1))
        lower = p(context[1:], word)
        return (counts[(*context, word)] + lm.PRIOR * lower) / (counts[context] + lm.PRIOR) if counts[context] else lower

    want = []
    for r in given:
        w = tokens(r.text)
        want.append((r.doc_id or -1, held(r.doc_id), len(w), sum(counts[(x,)] > 0 for x in w), round(sum(math.log10(p((), x)) for x in w), 6),
                     round(sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w)), 6)))
    got = lm.score(spark, docs, order, block_bytes=block_bytes, range_keys=range_keys).collect()
    key = lambda x: (x[0], x[2], x[4])
    have = sorted([(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got], key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=2e-6)
    assert {r.train_tokens for r in got} == {n}


def test_counts_move_one_order_at_a_time(spark, monkeypatch):
    """The packed n-grams of all orders are never on disk together: the sums of each are stored before the next is counted."""
    stored, rng = [], random.Random(5)
    monkeypatch.setattr(lm, "materialise", lambda s, df, name, own=lm.materialise: stored.append((name, own(s, df, name))) or stored[-1][1])
    docs = spark.createDataFrame([(i, " ".join(rng.choices(WORDS[:12], k=60))) for i in range(80)], "doc_id long, text string")
    assert lm.score(spark, docs, 3, block_bytes=4_000, range_keys=1_000).count() == 80
    sent = [df.agg(F.coalesce(F.sum(F.length("others")), F.lit(0))).first()[0] for name, df in stored if name.startswith("added")]
    assert max(sent) <= 0.6 * sum(sent)


def test_language_model_without_rows(spark, odd, empty):
    assert lm.score(spark, empty).count() == 0
    alone = odd.where("doc_id = 3").withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)).cast("long"))
    r = lm.score(spark, alone).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 1) and math.isfinite(r.score)


# licences


def test_licences(spark, odd, empty):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choices(WORDS, k=30))
    cases = [
        ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("This work is licensed under the GNU General Public License, version 2.", "gpl"),
        ("He lost his driving license in a public place.", None), ("Permission was granted to use the software room.", None), ("SPDX-License-Identifier: BSD-2-Clause", "bsd-2-clause"),
        ("SPDX-License-Identifier: AGPL-3.0-only", "agpl"), ("SPDX-License-Identifier: ISC", "isc"), ("This code is MIT licensed.", "mit"), ("Available under the Apache 2 licence.", "apache-2.0"),
        ("You may use it under CC BY-ND 4.0.", "cc-by-nd"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, in source code form or as a compiled binary, for any purpose.", "unlicense"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl"), ("The museum shows works of the public domain and of modern masters.", None),
    ]
    rows = [(i, f"{prose()}\n{line}\n{prose()}") for i, (line, _) in enumerate(cases)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.notices(spark, docs).collect()
    assert {r.doc_id: r.family for r in got} == {i: f for i, (_, f) in enumerate(cases) if f}
    for r in got:
        assert dict(rows)[r.doc_id][r.start : r.end] == cases[r.doc_id][0] and r.paragraph == 1 and 0 < r.probability <= 1
    wrapped = "Ünü\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nend"
    one = licenses.notices(spark, spark.createDataFrame([(1, wrapped), (1, wrapped)], "doc_id long, text string")).collect()
    assert len(one) == 2 and one[0].family == "gpl" and wrapped[one[0].start : one[0].end].startswith("This program") and wrapped[one[0].start : one[0].end].endswith("version.")
    assert licenses.notices(spark, empty).count() == licenses.notices(spark, odd).count() == 0


def test_held_out_damage_is_recognised():
    unknown = [random.Random(i).choices([w.encode() for w in WORDS], k=20) for i in range(300)]
    model = licenses.train(unknown)
    x, y = licenses._examples(99)
    p = licenses._softmax(licenses.margins(x, model.weights) / model.temperature)
    known = [i for i, k in enumerate(y) if k]
    assert sum(int(p[i].argmax()) == y[i] for i in known) > 0.95 * len(known)
    # mentions of a form that the model has not seen
    part, own = licenses._examples(1, 0), licenses._examples(1, 1)
    weights = licenses._weights(part[0] + unknown, np.array(part[1] + [0] * len(unknown)))
    mentions = [(w, k) for w, k in zip(*own, strict=True) if k and w[:3] == [b"released", b"under", b"the"]]
    found = licenses._softmax(licenses.margins([w for w, _ in mentions], weights)).argmax(1)
    assert (found == np.array([k for _, k in mentions])).mean() > 0.9 and len(mentions) > 100


def plain_similarities(paragraph):
    out = {}
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            w = licenses.words(t.encode())
            n = min(3, len(w), len(paragraph))
            own, its = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (paragraph, w))
            if n > 1 and own & its:
                out[family] = max(out.get(family, 0), len(own & its) / (min(len(own), len(its)) if len(paragraph) >= 5 else len(its)))
    return out


def test_similarities_to_all_templates():
    rng = random.Random(1)
    texts = [licenses.words(t.encode()) for ts in licenses.TEMPLATES.values() for t in ts]
    for _ in range(60):
        w = list(rng.choice(texts))
        w = [rng.choice(w) if rng.random() < 0.2 else x for x in w][: rng.randrange(1, 40)]
        assert licenses.similarities(w) == pytest.approx(plain_similarities(w))


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            if kind == "card":
                d = [int(x) for x in digits[::-1]]
                ok = 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
            if kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    pieces = ["a@b.co", "@", "x.y@z", "a@b.c@d.e", "@@a@b.c.", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "01.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", "12 34", "+1 (437) 555-0689", "+1", "++12 34567890123", "é", " ", ".", "-", "(", "日本", "9" * 30]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(12)))
        got = [f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text) if s.kind in pii.BASE]
        assert got == plain_spans(text), text


def test_validators_and_context():
    kinds = lambda t: [s.kind for s in pii.find_spans(t)]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("account GB82WEST12345698765433") == []
    assert kinds("her SSN is 123-45-6789") == ["ssn"] and kinds("part number 123-45-6789") == [] and kinds("SSN 000-45-6789") == []
    assert kinds("call (555) 123-4567 now") == ["local_phone"] and kinds("version (555) 123-4567") == []
    assert pii.find_spans("1" * 200_000) == [] and pii.find_spans("a" * 200_000 + "@") == []


def test_personal_data_query_and_redaction(spark, odd, empty, tmp_path):
    rows = [(1, "Mail a.b@c.de or +1 (437) 555-0689, 192.168.0.1; card 4111 1111 1111 1111."), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_pii(spark, str(tmp_path)).collect()}
    spans = plain_spans(rows[0][1])
    assert got[1].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and got[1].spans == ",".join(spans)
    assert [got[1][f"n_{k}"] for k in PATTERNS] == [1, 1, 1, 1] and got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert clean.orderBy("doc_id").first().text == "Mail [EMAIL] or [PHONE], [IP]; card [CARD]." and clean.where("doc_id = 2").first().text is None
    assert pii.redact(odd).count() == odd.count() and pii.redact(odd).columns == odd.columns and pii.redact(empty).count() == 0


# decontamination


def plain_hit(doc, item, window=20, agree=0.8):
    words = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).split()
    d, t = words(doc), words(item)
    size = min(len(t), window)
    if size < decontam.LEAST:
        return False
    for diagonal in range(-len(t) + 1, len(d)):
        same = [0 <= diagonal + k < len(d) and d[diagonal + k] == t[k] for k in range(len(t))]
        if any(sum(same[k : k + size]) >= agree * size for k in range(len(t) - size + 1)):
            return True
    return False


def test_passages_with_substitutions(spark, odd):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([4, 6, 11, 15, 40, 60])))) for i in range(40)]
    rows, exact = [], 0
    for d in range(150):
        words = rng.choices(WORDS, k=120)
        if d < 100:
            passage = items[d % 40][1].split()
            for _ in range(rng.randrange(len(passage) // 8 + 1)):
                passage[rng.randrange(len(passage))] = rng.choice(WORDS)
            at = rng.randrange(120)
            words[at:at] = passage
        rows.append((d, " ".join(words).upper() if d % 2 else ", ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "a b")], "item_id long, text string"))
    want = {(d, i) for d, t in rows for i, x in items if plain_hit(t, x)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, docs, bench).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 80
    clean = decontam.decontaminate(spark, docs, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.parts(bench, 2000)[1] > 1
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, docs, bench, chars=2000).collect()} == got
    assert {r.doc_id for r in decontam.decontaminate(spark, docs, bench, chars=2000).collect()} == {r.doc_id for r in clean.collect()}
    assert decontam.decontaminate(spark, odd, bench).count() == odd.count()


def test_repeated_words_and_empty_sides(spark, odd, empty):
    bench = spark.createDataFrame([(1, "for " * 30), (2, "for " * 12)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "for " * 3000), (2, "for and " * 50)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(spark, docs, bench).collect()} == {(1, 1), (1, 2)}
    assert decontam.contaminated(spark, empty, bench).count() == decontam.contaminated(spark, docs, bench.limit(0)).count() == 0


# quality


def test_quality_on_held_out_labels(spark, data):
    docs, labels = (spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs.select("doc_id", "text"), labels)
    scored = docs.withColumn("held_out", quality.held_out(F.col("doc_id"), 5)).withColumn("score", quality.score(F.col("text"), model))
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    assert len(rows) > 50 and sum((r.score >= quality.THRESHOLD) == (r.quality == 1) for r in rows) >= 0.95 * len(rows)
    other = quality.fit(spark, docs.select("doc_id", "text"), labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id"), 5), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert other == model


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 1), (77, 1)], "doc_id long, quality int")
    for docs in (odd, empty):
        model = quality.fit(spark, docs, labels)
        got = docs.withColumn("score", quality.score(F.col("text"), model)).collect()
        assert all(0 <= r.score <= 1 for r in got) and len(got) == docs.count()
    good, bad = b"plain good words " * 50, b"### BAD!! " * 80
    assert quality.score(F.lit("x"), quality.Model(good, bad, (0.0, 9.0, 0, 0, 0, 0), 0.5)) is not None
    assert quality.features(good, good, bad)[1] > 0 > quality.features(bad, good, bad)[1]
