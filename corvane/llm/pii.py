"""Personal data: expressions propose spans, validators confirm them.

The base kinds are fixed: email, ip, card (Luhn) and phone. The further kinds,
``iban`` (mod-97), ``ssn`` and ``local_phone``, start from a score of their own
that a confirmed checksum and words near the span raise or lower, and count from
a threshold on. Spans are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
THRESHOLD = 0.5
#: Characters on either side of a span in which context words count.
NEAR = 48

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A look-behind lets each run of digits be tried once, from its start; a later start can't match where that fails.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])")
#: Starting score and the words that raise it.
FURTHER = {
    "iban": (0.4, re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I)),
    "ssn": (0.3, re.compile(r"\b(?:ssn|social security|taxpayer)\b", re.I)),
    "local_phone": (0.3, re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|cell|tel[eé]fono|handy)\b", re.I)),
}
#: Words that speak against personal data.
AGAINST = re.compile(r"\b(?:order|invoice|version|isbn|serial|part number|sample|dummy)\b", re.I)
CHECKSUM, CONTEXT, OPPOSED = 0.4, 0.35, 0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern of local part, @ and domain finds, from each @ outwards.

    An @ can't be part of either side, so the leftmost match of each starts at the
    run of local-part characters before it, or where the last match ended. This way
    a long run without an @ is never searched.
    """
    end = 0
    at = text.find("@")
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > end and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, domain.end()
                end = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    found = [Span("email", s, e, 1.0) for s, e in _emails(text)]
    found += [Span("ip", m.start(), m.end(), 1.0) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", m.start(), m.end(), 1.0))
    found += [Span("phone", m.start(), m.end(), 1.0) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def further_spans(text: str, threshold: float) -> list[Span]:
    found = []
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("local_phone", LOCAL_PHONE)):
        score, words = FURTHER[kind]
        for m in pattern.finditer(text):
            around = text[max(0, m.start() - NEAR) : m.start()] + " " + text[m.end() : m.end() + NEAR]
            s = score + (CHECKSUM if kind == "iban" and mod97(m[0]) else -CHECKSUM if kind == "iban" else 0.0)
            s += CONTEXT * bool(words.search(around)) - OPPOSED * bool(AGAINST.search(around))
            if s >= threshold:
                found.append(Span(kind, m.start(), m.end(), round(min(1.0, s), 2)))
    return found


DIGIT = re.compile(r"[0-9]")


def find_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind in the order of ``KINDS``."""
    if not text or not ("@" in text or DIGIT.search(text)):
        return []
    return sorted(base_spans(text) + further_spans(text, threshold), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def pii_spans(text: Column, threshold: float = THRESHOLD) -> Column:
    """Array of the spans of a text column; null and empty texts have none. Whole texts are searched, however long, in time proportional to their length but for long runs of digits, and equal texts have equal spans."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[s._asdict() for s in find_spans(t.as_py(), threshold)] for t in texts], _ARROW)

    return spans(text)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets.

    Overlapping spans become one, named after the first. ``n_chars``, if there is such a column,
    is the new length. Null texts stay null, and empty ones empty. All columns and rows stay, repeated ones too; an empty table stays empty. Whole texts are searched, however long.
    """

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            spans = find_spans(text, threshold)
            if spans:
                parts, at = [], 0
                for s in spans:
                    if s.start >= at:
                        parts += [text[at : s.start], f"[{s.kind.upper()}]"]
                    at = max(at, s.end)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
