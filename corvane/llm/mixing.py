"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key that a hash makes random. Within each source the
documents are ordered by key; the mix takes whole epochs while the target allows
and then the documents whose running total of words stays within the rest, the
last one in part. The order is never sorted as a whole: keys fall into buckets of
equal range, bucket sums per source are pre-aggregated, and a running total over
them finds the one bucket in which a source's cut falls. Only that bucket's
documents are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Hex digits of the key that name its bucket, at least and at most, and the documents of a bucket, about, where all are of one source.
DIGITS, MOST_DIGITS, IN_BUCKET = 3, 6, 4096
#: Decimals of a target, so that it doesn't depend on the order of a sum.
DECIMALS = 6


def running_totals(spark: SparkSession, df: DataFrame, order: list, totals: dict[str, str]) -> DataFrame:
    """``df`` with a running total, itself excluded, of each named column.

    Rows are range-sorted over the cluster and stored with their partition, each
    partition is summed, and the sums before it are added to the totals within it.
    """
    sorted_rows = materialise(spark, df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_rows.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in totals])
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sorted_rows.join(offsets, "_part")
    for c, name in totals.items():
        out = out.withColumn(name, F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_part", *[f"_{c}" for c in totals])


def source_targets(spark: SparkSession, sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Water-filling in closed form: sources reach their limit in the order of limit over
    weight, so the common level is found where it first stays below the next one's.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = F.lit(1).cast("long")
    ranked = running_totals(spark, sums.withColumn("one", one), [F.col("source").asc_nulls_last()], {"one": "rank"})
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = ranked.withColumn("weight", w.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    limit = limit.withColumn("ratio", F.col("limit") / F.col("weight")).drop("one", "rank")
    filled = running_totals(spark, limit, [F.col("ratio"), F.col("source").asc_nulls_last()], {"limit": "limit_before", "weight": "weight_before"})
    whole = filled.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))
    level = (F.col("all_words") * F.lit(float(share)) - F.col("limit_before")) / (F.col("all_weight") - F.col("weight_before"))
    levels = filled.join(F.broadcast(whole)).withColumn("level", level).where(F.col("level") <= F.col("ratio") * (1 + 1e-12))
    # one row: the level of the first source that stays within its limit
    chosen = levels.agg(F.min_by("level", "ratio").alias("level"))
    target = F.round(F.least(F.col("weight") * F.coalesce(F.col("level"), F.lit(float("inf"))), F.col("limit")), DECIMALS)
    return filled.join(F.broadcast(chosen)).select("source", "source_size", target.alias("target"))


def _digits(n: int) -> int:
    return min(MOST_DIGITS, max(DIGITS, next(d for d in range(1, 17) if 16**d * IN_BUCKET >= n)))


def mix(spark: SparkSession, docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size, source_size, target, taken`` added.

    ``docs`` has ``doc_id``, ``text`` and ``source``; its other columns stay, but those
    that have a name of the four go. ``size`` is the number of words (null text: 0).
    The sources, in the order of their code points with null last, weigh
    ``weights``, repeating, and share ``share`` times all words; a source's target
    is ``most`` times its words at most, and what exceeds that goes to the
    others by weight. ``taken`` is the number of words that the mix takes from the row, over
    all its epochs: the sum over a source is its target, rounded down. Rows with the same
    id and size are interchangeable. A source without words has target 0. An
    empty table gives no rows. The result depends on the rows and the seed alone.
    """
    added = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c.lower() not in added]
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")
    key = F.md5(F.concat(F.lit(f"{seed}:"), id_, F.lit(":"), text)).alias("key")
    # the row's own columns stay in one struct, so that their names mean nothing here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "source", "doc_id", size, key)
    narrow = materialise(spark, rows.select("source", "size", "key"), "sizes")
    digits = F.lit(_digits(narrow.count()))
    bucket = F.substring("key", F.lit(1), digits).alias("bucket")
    narrow = narrow.select("source", "size", bucket)
    targets = materialise(spark, source_targets(spark, narrow, share, most, weights), "targets")
    # the bucket of each source in which its cut falls
    sums = narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.floor("target") - F.col("epochs") * F.col("source_size"))
    cut = before.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    cut = cut.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut = cut.select(F.col("source").alias("c"), F.col("bucket").alias("cut"), F.col("before").alias("from"))
    plan = materialise(spark, plan.join(cut, F.col("source").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("source", "planned"), "plan")
    known = rows.withColumn("bucket", bucket).join(plan, F.col("source").eqNullSafe(F.col("planned")))
    at_cut = F.col("cut").isNotNull() & (F.col("bucket") == F.col("cut"))
    base = F.col("epochs") * F.col("size")
    # words before this row within its source's cut bucket; only that bucket is sorted
    inner = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("from") - F.coalesce(F.sum("size").over(inner), F.lit(0))))
    sorted_part = known.where(at_cut).withColumn("taken", (base + extra).cast("long"))
    whole = F.when(F.col("cut").isNull() | (F.col("bucket") > F.col("cut")), F.lit(0)).otherwise(F.col("size"))
    rest = known.where(~at_cut).withColumn("taken", (base + whole).cast("long"))
    return rest.unionByName(sorted_part).select("row.*", *added)
