"""A training corpus out of raw documents, in five stages.

Each stage takes all rows that the one before it kept and returns the columns of
``documents``; the last adds what the mix takes of each. Between stages the rows
are written to the shared folder and read again. Empty tables pass through all stages; columns beside ``doc_id``, ``text`` and ``source`` stay as
they are, but for ``n_chars``, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, mixing, pii, quality, simhash
from corvane.llm.storage import discard, materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; null texts are judged as empty ones, repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(spark, docs, labels)
    # the row's own columns stay in one struct, so that their names mean nothing here
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), quality.score(F.col("text"), model).alias("score"))
    return scored.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by SimHash and its covering as ``simhash.drop_near_duplicates`` says; null and empty texts are one group."""
    return simhash.drop_near_duplicates(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts hold none, and all copies of a row fare alike."""
    return decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; all rows stay, and null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many words of each; null and empty texts are never taken."""
    return mixing.mix(spark, docs).where("taken > 0")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
]

#: The classifier and the connected groups are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = materialise(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(spark, before)
        docs = before = after
    return docs
