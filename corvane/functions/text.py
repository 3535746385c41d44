"""Scalar functions on text, as Columns that stay in the JVM.

Offsets and lengths are Unicode code points, which is what Spark's string functions count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark text which may try to instruct a model.
SUSPICIOUS = (
    "ignore previous instructions",
    "system prompt:",
    "<system>",
    "</system>",
    "override policy",
    "you are now",
    "execute command",
    "<evidence>",
    "</evidence>",
)
#: All blanks of Unicode, which a trim takes away; Java's own class of blanks is that of ASCII.
BLANK = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def fold_name(name: Column) -> Column:
    """Trimmed of all blanks, not spaces alone, and lower-cased; how entity names are compared."""
    return F.lower(trimmed(name))


# Characters with a meaning in markup and their entities; the ampersand comes first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_markup(text: Column) -> Column:
    """The five characters with a meaning in markup as entities."""
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def suspicious(*texts: Column) -> Column:
    """Whether some text holds one of the phrases, in any case. Nulls hold none."""
    found = F.lit(False)
    for text in texts:
        lower = F.lower(F.coalesce(text, F.lit("")))
        for phrase in SUSPICIOUS:
            found = found | lower.contains(phrase)
    return found


def excerpt(text: Column, chars: int) -> Column:
    """The first ``chars`` code points, and whether something was cut."""
    return F.struct(F.substring(text, 1, chars).alias("excerpt"), (F.length(text) > chars).alias("truncated"))


def content_type(filename: Column) -> Column:
    name = F.lower(filename)
    return F.when(name.endswith(".json"), "application/json").when(name.endswith(".md"), "text/markdown").otherwise("text/plain")


def chunk_strategy(filename: Column, requested: Column) -> Column:
    """JSON files are always cut by size."""
    return F.when(F.lower(filename).endswith(".json") | (requested == "fixed_size"), "fixed_size").otherwise("structure_aware")


def lossy_text(raw: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def content_hash(text: Column) -> Column:
    """SHA-256 in hex. It is an opaque key, so any stable digest serves."""
    return F.sha2(text, 256)


def estimate_tokens(text: Column) -> Column:
    """Four tokens for three words, and one: the estimate where no vocabulary is at hand."""
    words = F.size(F.regexp_extract_all(text, F.lit(BLANK.replace("[", "[^", 1) + "+"), F.lit(0)))
    return F.floor(words * 4 / 3).cast("int") + 1


def inline_markers(answer: Column) -> Column:
    """Strict citation markers such as [12]."""
    return F.regexp_extract_all(answer, F.lit(r"\[[0-9]+\]"), F.lit(0))


def loose_markers(answer: Column) -> Column:
    """Citation markers that may hold blanks, such as [ 12 ]."""
    return F.regexp_extract_all(answer, F.lit(r"\[[ \t\n\f\r]*[0-9]+[ \t\n\f\r]*\]"), F.lit(0))


def ascii_marker(marker: Column) -> Column:
    """A marker without brackets and blanks; for markers of ASCII digits this equals the full normal form."""
    return F.regexp_replace(F.lower(marker), r"[\s\[\]()]+", "")


def is_uuid4(value: Column) -> Column:
    return F.lower(value).rlike(UUID4)


def safe_header(value: Column, chars: int) -> Column:
    """Visible ASCII only, at most ``chars`` of it."""
    return F.substring(F.regexp_replace(value, "[^!-~]", ""), 1, chars)


def backoff_seconds(retries: Column, doublings: int = 10, most: int = 60) -> Column:
    return F.least(F.pow(F.lit(2.0), F.least(retries, F.lit(doublings))), F.lit(float(most))).cast("int")


def saturating_int(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(2147483647)).cast("int")


def valid_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The parser stops after the first value; within an array and within an object, what follows is an error.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(F.try_parse_json(text).isNotNull() & in_array & in_object, F.lit(False))


def unknown_keys(text: Column, known: list[str]) -> Column:
    """Keys of a JSON object that aren't among the known ones; null for what is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, known))))


# Fixed value: the largest request body in bytes.
MAX_BODY_BYTES = 32 * 1024


def strict_json(text: Column, schema: str) -> Column:
    """A JSON object of the schema's fields alone, of at most ``MAX_BODY_BYTES``; anything else fails the query."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fieldNames()
    ok = (F.octet_length(text) <= MAX_BODY_BYTES) & valid_json(text) & F.coalesce(F.size(unknown_keys(text, fields)) == 0, F.lit(False))
    parsed = F.from_json(text, schema, {"mode": "FAILFAST"})
    return F.when(ok, parsed).otherwise(F.raise_error(F.concat(F.lit("malformed or too large object or unknown key in: "), F.substring(text, 1, 80))))
