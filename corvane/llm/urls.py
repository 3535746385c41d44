"""URL filter: rules first, then gradient-boosted trees on lexical features.

Features and scores are DataFrame expressions. The trees are fitted on a bounded
sample of labelled URLs, whose few numbers a row go to the driver, and become
nested conditions. The labels come from terms in the host's name. Features see the form of a host (its
length, hyphens, longest label, characters), not which words it has, so the trees judge hosts without a known term by how they
look. Whole hosts are held out, so what is measured on them is about names that were not seen.
"""

from __future__ import annotations

import string
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import materialise

#: (host, path, verdict), fixed.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Terms of a host's labels but the last that mark a training URL as unwanted.
TERMS = ("casino", "bets", "betting", "poker", "pills", "pharma", "spam", "adult", "porn", "xxx", "ads", "track", "loans", "replica", "cheap", "hacked", "malware", "phish")
#: Rows in the training sample at most; folds by crc32 of the host, of which fold 0 is held out.
SAMPLE, FOLDS = 20_000, 5
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 30, 3, 0.3, 32, 5, 1.0
THRESHOLD = 0.5
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "params", "labels", "longest_label", "hyphens", "symbol_ratio", "secure", "suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``.

    Both are empty if the URL is null or has no ``://``.
    """
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; null if none fits."""
    names, verdicts = [], []
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        names.append(F.when(fits, F.lit(h + p)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    return F.coalesce(*names), F.coalesce(*verdicts)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def labelled(host: Column) -> Column:
    """1 for a host with a term, as a word between dots and hyphens, in some label but the last."""
    return F.when(host.rlike("(^|[.-])(" + "|".join(TERMS) + r")[.-]"), 1.0).otherwise(0.0)


def held_out(host: Column, fold: int = 0, folds: int = FOLDS) -> Column:
    return F.crc32(host.cast("binary")) % folds == fold


def features(url: Column, host: Column, path: Column, suffix_rate: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    kept = lambda text, pattern: F.length(F.regexp_replace(text, pattern, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    labels = F.split(host, r"\.")
    columns = (
        F.length(u), F.length(host), F.length(path), kept(path, "[^/]"), kept(u, "[^0-9]") / n, entropy, kept(u, "[^=]"), F.size(labels),
        F.array_max(F.transform(labels, F.length)), kept(host, "[^-]"), kept(u, "[A-Za-z0-9]") / n, u.startswith("https:").cast("int"), suffix_rate,
    )
    return {name: c.cast("double") for name, c in zip(FEATURES, columns, strict=True)}


class Node(NamedTuple):
    """``feature`` is negative for a leaf; values up to ``cut`` go left."""

    feature: int
    cut: float
    left: Node | None
    right: Node | None
    value: float


def _grow(x: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Node:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    leaf = Node(-1, 0.0, None, None, float(RATE * total_g / (total_h + RIDGE)))
    best = (1e-9, -1, -1)
    if depth:
        for f, edges in enumerate(cuts):
            if edges.size:
                left_g = np.cumsum(np.bincount(x[rows, f], g[rows], edges.size + 1))[:-1]
                left_h = np.cumsum(np.bincount(x[rows, f], h[rows], edges.size + 1))[:-1]
                count = np.cumsum(np.bincount(x[rows, f], minlength=edges.size + 1))[:-1]
                gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(count < LEAST) | (rows.size - count < LEAST)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
    if best[1] < 0:
        return leaf
    _, f, k = best
    left = x[rows, f] <= k
    return Node(f, float(cuts[f][k]), _grow(x, cuts, rows[left], g, h, depth - 1), _grow(x, cuts, rows[~left], g, h, depth - 1), 0.0)


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Node]]:
    """Log-odds of the mean, and the trees whose values are added to it."""
    mean = (y.sum() + 0.5) / (y.size + 1.0)
    base = float(np.log(mean / (1 - mean)))
    if not 0 < y.sum() < y.size:
        return base, []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin, trees = np.full(y.size, base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(binned, cuts, np.arange(y.size), y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        margin = margin + value(tree, x)
    return base, trees


def value(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature < 0:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.cut, value(tree.left, x), value(tree.right, x))


def _expression(tree: Node) -> Column:
    if tree.feature < 0:
        return F.lit(tree.value)
    return F.when(F.col(f"_f.{FEATURES[tree.feature]}") <= tree.cut, _expression(tree.left)).otherwise(_expression(tree.right))


class Model(NamedTuple):
    """``suffix_rates``: ``_suffix, _rate``, one row for each suffix of enough training pages."""

    base: float
    trees: list
    suffix_rates: DataFrame
    prior: float


def _with_rates(rows: DataFrame, host: str, rates: DataFrame, prior: float) -> DataFrame:
    return rows.withColumn("_suffix", suffix(F.col(host))).join(rates, "_suffix", "left").withColumn("_rate", F.coalesce("_rate", F.lit(prior)))


def fit(pages: DataFrame, sample: int = SAMPLE, fold: int = 0) -> Model:
    """Trees of at most ``sample`` of the pages outside the held-out fold of hosts, in the order of a hash of url and id.

    Suffix statistics are smoothed shares of unwanted URLs among all pages outside that fold; a suffix of
    fewer than ``LEAST`` has the mean. Null URLs teach nothing, repeated rows count as often as they are there, and other columns are not looked at, but for ``page_id``. An empty
    table, or one of a single class, gives no trees: every score is the mean.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.where("url is not null").withColumn("_host", host).withColumn("_path", path)
    rows = rows.where(~held_out(F.col("_host"), fold))
    counts = rows.groupBy(suffix(F.col("_host")).alias("_suffix")).agg(F.sum(labelled(F.col("_host"))).alias("unwanted"), F.count("*").alias("n"))
    counts = materialise(pages.sparkSession, counts, "suffixes")
    total = counts.agg(F.coalesce(F.sum("unwanted"), F.lit(0.0)).alias("unwanted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    prior = float((total.unwanted + 0.5) / (total.n + 1.0))
    rates = counts.where(F.col("n") >= LEAST).select("_suffix", ((F.col("unwanted") + 10 * prior) / (F.col("n") + 10)).alias("_rate"))
    # by their hash about twice as many as are wanted, so that what tasks send doesn't grow with their number
    share = min(1.0, 2 * sample / max(1, pages.count()))
    rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = rows.select("url", "page_id", "_host", "_path", labelled(F.col("_host")).alias("y")).orderBy(F.xxhash64("url", "page_id"), "url").limit(sample)
    found = features(F.col("url"), F.col("_host"), F.col("_path"), F.col("_rate"))
    data = _with_rates(chosen, "_host", rates, prior).orderBy(F.xxhash64("url", "page_id"), "url").select("y", *[c.alias(n) for n, c in found.items()]).collect()
    y = np.array([r.y for r in data], float)
    x = np.array([r[1:] for r in data], float).reshape(-1, len(FEATURES))
    return Model(*fit_trees(x, y), rates, prior)


def judge(pages: DataFrame, model: Model, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score`` added.

    ``pages`` has ``url``; columns of the five names go, the others stay as they are, whatever their names. The longest fitting rule
    decides, else the score, the probability that the URL is unwanted: ``block`` from
    ``threshold`` on. Null and odd URLs have empty hosts and are judged by the trees like any other. Repeated rows fare alike, URLs of any length are read
    whole, and an empty table gives no rows.
    """
    added = ["host", "path", "rule", "verdict", "score"]
    kept = [c for c in pages.columns if c.lower() not in added]
    host, path = host_and_path(F.col("url"))
    # the row's own columns stay in one struct, so that their names mean nothing here
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    rows = pages.select(row.alias("row"), "url", host.alias("host"), path.alias("path"))
    rows = _with_rates(rows, "host", model.suffix_rates, model.prior)
    found = features(F.col("url"), F.col("host"), F.col("path"), F.col("_rate"))
    rows = rows.withColumn("_f", F.struct(*[c.alias(n) for n, c in found.items()]))
    margin = F.lit(model.base)
    for tree in model.trees:
        margin = margin + _expression(tree)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("score", 1 / (1 + F.exp(-margin)))
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce(verdict, by_score)).select("row.*", *added)
