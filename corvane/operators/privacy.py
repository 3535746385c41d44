"""Fields of JSON documents that must not leave a system, found by name at any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import stored

# Classes of sensitive fields and what their names contain, the first class that fits holds.
CATEGORIES = (
    ("credential", ("credential", "credentials")),
    ("secret", ("secret", "secrets", "api_key", "apikey")),
    ("bearer", ("bearer", "bearer_token")),
    ("authorization_header", ("authorization", "header", "authorization_header")),
    ("raw_content", ("raw_content", "raw_bytes", "raw_upload", "raw_data", "uploaded_bytes")),
    ("document_text", ("document_text", "stored_document_text", "stored_content")),
    ("chunk_content", ("chunk_content", "stored_chunk_content")),
)
#: Containers within containers, beyond which a document is refused.
DEEPEST = 64


def category(name: Column) -> Column:
    """The class of a field's name, however its words are joined; null for a harmless one."""
    words = F.regexp_replace(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]", "_")

    def of(form: Column) -> Column:
        has = lambda k: F.contains(form["words"], F.lit(k)) | F.contains(form["joined"], F.lit(k.replace("_", "")))
        return F.coalesce(*[F.when(reduce(Column.__or__, map(has, keys)), F.lit(c)) for c, keys in CATEGORIES])

    # bound to a variable, so that both forms are made once and not for each of the names
    forms = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.replace(w, F.lit("_"), F.lit("")).alias("joined")))
    return F.get(F.transform(forms, of), F.lit(0))


def fields(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, field`` of every field of the JSON in ``text``, at any depth: a path of ``.member`` and ``[index]`` steps from ``root``.

    A level of all documents at a time: the members of one level's containers are the next level. A level is stored with its fields, so it is made once.
    Texts that are no JSON, and null ones, have no fields. A document deeper than ``DEEPEST`` is an error.
    """
    found = [rows.select(key, F.lit("").alias("path"), F.lit("").alias("field")).limit(0)]
    level = _containers(rows.select(key, F.lit("root").alias("path"), F.lit(None).cast("string").alias("field"), F.try_parse_json(text).alias("value")))
    for _ in range(DEEPEST - 1):
        members = level.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("_pos", "_key", "_member"))
        step = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.lit(".member"))
        below = stored(_containers(members.select(key, F.concat("path", step).alias("path"), F.col("_key").alias("field"), F.col("_member").alias("value"))), "level")
        if below.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(below.where("field is not null").select(key, "path", "field"))
        level = below.where("value is not null")
    if not level.isEmpty():
        raise ValueError(f"JSON deeper than {DEEPEST} levels")
    return reduce(DataFrame.unionByName, found)


def _containers(rows: DataFrame) -> DataFrame:
    """Rows that name a field or hold a container, with no other value."""
    holds = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
    return rows.withColumn("value", F.when(holds, F.col("value"))).where("field is not null or value is not null")


def sensitive(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, category`` of the sensitive fields in ``text``; what they hold is never shown."""
    return fields(rows, key, text).withColumn("category", category(F.col("field"))).where("category is not null").select(key, "path", "category")
