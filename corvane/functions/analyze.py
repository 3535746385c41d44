"""Analyzers: text to index terms.

``plain_terms`` is a Column of the JVM: runs of letters, digits and underscores,
lower-cased. ``unicode_terms`` follows the Unicode rules (compatibility composition, word
boundaries, full case folding) and adds the parts of identifiers; it needs Python and works on
Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN = r"[\p{L}\p{N}_]+"
_PARTS = regex.compile(r"[_-]|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", regex.V1)


def plain_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN), F.lit(0))


def identifier_parts(word: str) -> list[str]:
    """Parts at underscores, hyphens, and where case rises; none for a word of one part."""
    parts = [p for p in _PARTS.split(word) if p]
    return parts if len(parts) > 1 else []


def _words(text: str) -> list[str]:
    # the boundaries between words; pieces without a letter or digit are not terms
    return [w for w in regex.split(r"\b", text, flags=regex.WORD | regex.V1) if any(c.isalnum() for c in w)]


def analyze(text: str | None) -> list[str]:
    """Terms in order: each word folded, then its parts, without a part equal to the term before it."""
    terms: list[str] = []
    for word in _words(unicodedata.normalize("NFKC", text or "")):
        terms.append(word.casefold())
        for part in map(str.casefold, identifier_parts(word)):
            if terms[-1] != part:
                terms.append(part)
    return terms


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unicode_terms(texts: pa.Array) -> pa.Array:
    return pa.array([analyze(t.as_py()) for t in texts], pa.list_(pa.string()))


def unicode_terms(text: Column) -> Column:
    return _unicode_terms(text)


def normal_marker(value: str) -> str:
    """A citation marker or evidence id in the form in which they are compared."""
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(folded.split()).strip("[]()").strip()


@F.arrow_udf(T.StringType())
def _normal_marker(values: pa.Array) -> pa.Array:
    return pa.array([None if v.as_py() is None else normal_marker(v.as_py()) for v in values], pa.string())


def marker_form(value: Column) -> Column:
    return _normal_marker(value)


def vector_digest(vector: list[float]) -> str:
    """FNV-1a, 64 bits, over the length (8 bytes) and the single-precision components, little endian, in hex."""
    import struct

    h = 0xCBF29CE484222325
    for byte in struct.pack("<Q", len(vector)) + struct.pack(f"<{len(vector)}f", *vector):
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
