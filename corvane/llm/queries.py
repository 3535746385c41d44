"""The registered queries of this subpackage: each applies an operator to its whole table.

Null ids, null and empty texts, repeated rows, empty tables and further columns are treated as the operator's docstring says; a query drops no row of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ann, bpe, codes, decontam, licenses, lm, mixing, paragraphs, periodic, pii, quality, simhash, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and lines of five words or more; texts without any have no row."""
    return paragraphs.repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), line_run=paragraphs.SHINGLE)


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score, one row each, also for null and empty texts."""
    return lm.score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices; texts without any have no row."""
    return licenses.notices(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, one row each, also for null and empty texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.pii_spans(F.col("text")).alias("found"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = joined(F.filter("found", lambda s: s["kind"].isin(*pii.BASE)))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents; clean documents have no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on URLs, one row each, also for null URLs."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components, one row each; the fingerprint of null and empty texts is zero."""
    near = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, one row each; null and empty texts have size 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, one row each, also for null and empty texts; the first label by size counts where an id has several."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(spark, docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id"), quality.FOLDS).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each query; vectors that take no part, null ids among them, have no row."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return ann.nearest(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, one row each, also for null and empty texts."""
    import public_tokenizers

    vocabulary = bpe.share(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    digests = F.sha2(bpe.packed(F.col("ids")), 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256")
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of vectors; those that are null or hold null or non-finite components have no row."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    found, books = codes.compress(spark, vectors)
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of each text, one row each; of every tenth or so of the ids, by a hash, a period is first written over the text's end. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # through a lambda, so that the words are cut out once
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(""))[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, changed).otherwise(text).alias("text"))
    found = periodic.find(docs).withColumn("best", periodic.strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries():
    named = (op1_paragraphs, op2_lm, op3_licenses, op4_pii, op5_decontam, op6_urls, op7_simhash, op8_mixing, op9_quality, op10_ann, op11_bpe, op12_codes, op13_periodic)
    return {f.__name__: f for f in named}
