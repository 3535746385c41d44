"""The driver's tables in the roles of documents, chunks, vectors, queries and graph, in Spark and in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import content_type
from corvane.operators.chunking import fixed_windows
from corvane.sources.index import InvertedIndex
from corvane.sources.shared import shared_dir, spread

SIZE, OVERLAP = 500, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filename():
    ending = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".json").otherwise(".txt")
    return F.concat("source", ending)


FILENAME_SQL = "source || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.json' ELSE '.txt' END"
TYPE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/json' ELSE 'text/plain' END"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spread(table(spark, sf_dir, "documents")))


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of rows like those of ``documents``."""
    docs = docs.withColumn("document_id", F.col("doc_id").cast("string"))
    docs = docs.select("document_id", "text", F.col("source").alias("title"), F.concat(F.lit("/"), "lang").alias("section_path"), content_type(filename()).alias("content_type"))
    rows = fixed_windows(docs, "text", SIZE, OVERLAP, ["document_id", "title", "section_path", "content_type"])
    return rows.withColumn("chunk_id", F.concat_ws(":", "document_id", "chunk_index"))


_indexes: dict[tuple[str, str], InvertedIndex] = {}


def kept_index(spark: SparkSession, sf_dir: str) -> InvertedIndex:
    """The index of the chunks, built for the first search and kept for all of the session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _indexes:
        _indexes[at] = InvertedIndex.build(spark, f"{shared_dir(spark)}/corvane/index-{uuid.uuid4().hex}", chunks(spark, sf_dir))
    return _indexes[at]


CHUNKS_SQL = f"""docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, text, length(text) AS n, source AS title, '/' || lang AS section_path,
         {TYPE_SQL} AS content_type
  FROM documents WHERE length(text) > 0),
windows AS (
  SELECT *, unnest(range(0, CASE WHEN n <= {SIZE} THEN 1 ELSE CAST(ceil((n - {SIZE}) / {SIZE - OVERLAP}.0) AS BIGINT) + 1 END)) AS k FROM docs),
chunks AS (
  SELECT document_id, CAST(k AS INTEGER) AS chunk_index, document_id || ':' || k AS chunk_id, title, section_path, content_type,
         CAST(k * {SIZE - OVERLAP} AS INTEGER) AS char_start, substring(text, 1 + k * {SIZE - OVERLAP}, {SIZE}) AS content
  FROM windows)"""


#: The stated query set of a search: rows whose id is divisible by this.
EVERY = 20
#: All blanks of Unicode, as ``functions.text.BLANK`` in DuckDB's form.
BLANK_SQL = "[\\x09-\\x0D\\x20\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items of the stated query set."""
    return questions(spark, sf_dir).where(F.col("query_id") % EVERY == 0)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as that of the first chunk of the document of the same number."""
    doc = F.col("vec_id").cast("string")
    kind = F.when(F.col("label") < 5, "text/plain").otherwise("text/markdown")
    return table(spark, sf_dir, "embeddings").select(
        doc.alias("document_id"), F.lit(0).alias("chunk_index"), F.concat(doc, F.lit(":0")).alias("chunk_id"), kind.alias("content_type"), "embedding"
    )


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


DENSE_SQL = """vectors AS (
  SELECT CAST(vec_id AS VARCHAR) AS document_id, 0 AS chunk_index, CAST(vec_id AS VARCHAR) || ':0' AS chunk_id,
         CASE WHEN label < 5 THEN 'text/plain' ELSE 'text/markdown' END AS content_type, embedding FROM embeddings),
distances AS (
  SELECT q.vec_id AS query_id, document_id, chunk_index, chunk_id, content_type,
         round(list_sum(list_transform(list_zip(v.embedding, q.embedding),
               lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 9) AS distance
  FROM vectors v, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)"""
