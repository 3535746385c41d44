"""Merging ranked lists by reciprocal rank, within a variant and across variants.

Lists are rows ``query_id, variant, source, document_id, chunk_index, chunk_id, score``;
everything runs for all queries at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.errors import InvalidSettings, NonFiniteScore
from corvane.operators.lexical import KEY
from corvane.settings import MAX_VARIANTS, RetrievalSettings

LIST = ("query_id", "variant")


def check_scores(rows: DataFrame) -> None:
    bad = rows.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).first()
    if bad:
        raise NonFiniteScore(f"chunk {bad['chunk_id']}")


def rank_lists(rows: DataFrame, limit: int, position: str | None = None) -> DataFrame:
    """Each list without repeats of a chunk (the first stays), cut at ``limit`` and ranked from 1.

    The order within a list is ``position`` if there is such a column, else score and key.
    """
    order = [F.col(position)] if position else [F.desc("score"), *map(F.col, KEY)]
    own = [*LIST, "source"]
    first = F.row_number().over(Window.partitionBy(*own, "chunk_id").orderBy(*order))
    distinct = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(*order))).where(F.col("rank") <= limit)


def _of(source: str, value: str):
    return F.max(F.when(F.col("source") == source, F.col(value)))


def fuse(rows: DataFrame, settings: RetrievalSettings | None = None, position: str | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of the sources ``vector`` and ``bm25`` of each variant.

    A source of weight 0 is left out. Returns for each chunk the keys, ``fused_score``, the rank and
    score in each source, ``best_rank``, ``provenance`` and ``rank`` (fused score, best rank, key). Contributions are
    added in the order of the sources, so a score has one value only.
    """
    s = settings or RetrievalSettings()
    weights = {"vector": s.vector_weight, "bm25": s.bm25_weight}
    used = rows.where(F.col("source").isin(*[k for k, w in weights.items() if w > 0]))
    ranked = rank_lists(used, s.candidate_limit, position)
    weight = F.when(F.col("source") == "vector", F.lit(float(s.vector_weight))).otherwise(F.lit(float(s.bm25_weight)))
    ranked = ranked.withColumn("contribution", weight / (F.lit(float(s.rrf_k)) + F.col("rank")))
    part = lambda source: F.coalesce(_of(source, "contribution"), F.lit(0.0))
    entry = F.struct("variant", "source", "rank", "score", "contribution")
    merged = ranked.groupBy(*LIST, *KEY).agg(
        (part("vector") + part("bm25")).alias("fused_score"),
        _of("vector", "rank").alias("vector_rank"),
        _of("bm25", "rank").alias("bm25_rank"),
        _of("vector", "score").alias("vector_score"),
        _of("bm25", "score").alias("bm25_score"),
        F.min("rank").alias("best_rank"),
        F.sort_array(F.collect_list(entry)).alias("provenance"),
    )
    order = Window.partitionBy(*LIST).orderBy(F.desc("fused_score"), "best_rank", *KEY)
    return merged.withColumn("rank", F.row_number().over(order))


def check_variants(rows: DataFrame) -> None:
    most = rows.groupBy("query_id").agg(F.countDistinct("variant").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MAX_VARIANTS:
        raise InvalidSettings(f"more than {MAX_VARIANTS} variants")


def fuse_variants(fused: DataFrame, settings: RetrievalSettings | None = None) -> DataFrame:
    """One list for each query out of its variants' fused lists.

    Scores are sums of 1 / (k + rank), without the sources' weights, over the first ``candidate_limit`` of each variant,
    added in the order of the variants. A query with one variant keeps its list and scores as they are. Rank and score in a source
    come from the variant with the best score there. Order: score, best rank, first variant, key.
    """
    s = settings or RetrievalSettings()
    variants = F.size(F.collect_set("variant").over(Window.partitionBy("query_id")))
    rows = fused.withColumn("_variants", variants)
    single = rows.where("_variants = 1")
    several = rows.where((F.col("_variants") > 1) & (F.col("rank") <= s.candidate_limit))
    step = F.struct("variant", (1.0 / (F.lit(float(s.rrf_k)) + F.col("rank"))).alias("c"))

    def best(source: str):
        have = F.col(f"{source}_score").isNotNull()
        key = F.struct(F.col(f"{source}_score"), -F.col("variant"), -F.col(f"{source}_rank"))
        return F.max(F.when(have, F.struct(key.alias("k"), F.col(f"{source}_rank").alias("rank"), F.col(f"{source}_score").alias("score"))))

    merged = several.groupBy("query_id", *KEY).agg(
        F.aggregate(F.sort_array(F.collect_list(step)), F.lit(0.0), lambda a, x: a + x["c"]).alias("fused_score"),
        best("vector").alias("v"),
        best("bm25").alias("b"),
        F.min("rank").alias("best_rank"),
        F.min("variant").alias("first_variant"),
        F.sort_array(F.flatten(F.collect_list("provenance"))).alias("provenance"),
    )
    columns = ["query_id", *KEY, "fused_score", "vector_rank", "bm25_rank", "vector_score", "bm25_score", "best_rank", "first_variant", "provenance"]
    merged = merged.withColumns({"vector_rank": F.col("v.rank"), "vector_score": F.col("v.score"), "bm25_rank": F.col("b.rank"), "bm25_score": F.col("b.score")})
    both = merged.select(*columns).unionByName(single.withColumn("first_variant", F.col("variant")).select(*columns))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "best_rank", "first_variant", *KEY)
    return both.withColumn("rank", F.row_number().over(order))


def final(fused: DataFrame, limit: int) -> DataFrame:
    return fused.where(F.col("rank") <= limit)


def result_hash(fused: DataFrame) -> DataFrame:
    """``query_id, result_hash``: a digest of the chunk ids in order, each ended by a zero character."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: F.concat(x["chunk_id"], F.lit("\x00")))
    return fused.groupBy("query_id").agg(F.sha2(F.array_join(ids, ""), 256).alias("result_hash"))
