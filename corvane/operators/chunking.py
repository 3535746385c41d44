"""Cutting documents into chunks. Offsets are code points, ends exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.markdown import headings
from corvane.functions.text import estimate_tokens

#: Windows of a piece of a text, and of a piece of that, from which windows are cut, so that a long text isn't walked anew for each.
TOGETHER = (512, 8)


def fixed_windows(docs: DataFrame, text: str, size: int | Column, overlap: int | Column, keys: list[str]) -> DataFrame:
    """Windows of ``size`` code points that share ``overlap`` with the one before.

    Adds ``chunk_index, char_start, char_end, content`` to ``keys``. The overlap is at most size - 1;
    the last window ends with the text. Null and empty texts and sizes below 1 give none.
    """
    size = size if isinstance(size, Column) else F.lit(size)
    overlap = overlap if isinstance(overlap, Column) else F.lit(overlap)
    step = size - F.least(overlap, size - 1)
    n = F.length(text)
    many = F.when((n > 0) & (size > 0), F.greatest(F.ceil((n - size) / step), F.lit(0)) + 1).otherwise(0)
    rows = docs.select(*keys, F.col(text).alias("_text"), size.cast("long").alias("_size"), step.cast("long").alias("_step"), many.cast("long").alias("_many")).where("_many > 0")
    rows = rows.withColumn("_from", F.lit(0).cast("long"))
    for together in (*TOGETHER, 1):
        # _many windows from the window _from on are in _text
        rows = rows.withColumn("_at", F.explode(F.expr(f"sequence(0L, greatest(_many - 1, 0L), {together}L)")))
        piece = F.expr(f"substring(_text, cast(1 + _at * _step as int), cast({together - 1} * _step + _size as int))")
        rows = rows.withColumns({"_text": piece, "_many": F.least(F.lit(together).cast("long"), F.col("_many") - F.col("_at")), "_from": F.col("_from") + F.col("_at")})
    start = F.col("_from") * F.col("_step")
    out = rows.select(*keys, F.col("_from").cast("int").alias("chunk_index"), start.cast("int").alias("char_start"), F.col("_text").alias("content"))
    return out.select(*keys, "chunk_index", "char_start", (F.col("char_start") + F.length("content")).alias("char_end"), "content")


def paragraphs(text: Column) -> Column:
    """A text cut after each blank line; the blank line stays with what it ends."""
    return F.regexp_extract_all(text, F.lit(r"(?s).*?\n\n|.+"), F.lit(0))


def section_path(names: list[str]) -> str | None:
    named = [n for n in names if n.strip()]
    return "/" + "/".join(named) if named else None


def _windows(text: str, start: int, size: int, overlap: int):
    step = size - min(overlap, size - 1)
    for k in range(0, max(1, len(text) - size + step), step):
        yield start + k, text[k : k + size]


_PARTS = re.compile(r"(?s).*?\n\n|.+")


def _cut(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, str | None]]:
    """Start, content and section path of one chunk after the other."""
    names: list[str] = []

    def region(start: int, end: int) -> Iterator[tuple[int, str, str | None]]:
        path = section_path(names)
        for part in _PARTS.finditer(text, start, end):
            for s, content in _windows(part.group(), part.start(), size, overlap):
                yield s, content, path

    if text and size > 0:
        at = 0
        for h in headings(text):
            yield from region(at, h.start)
            names[:] = (names[: h.level - 1] + [""] * (h.level - 1 - len(names)))[: h.level - 1] + [h.title]
            yield from region(h.start, h.end)
            at = h.end
        yield from region(at, len(text))


def cut_markdown(text: str, size: int, overlap: int) -> list[dict]:
    """Chunks of the regions between headings and of the headings themselves.

    A region is cut after each blank line, and each part into windows. Headings of a
    deeper level belong to those above; skipped levels are blank and left out of the path.
    """
    return [{"char_start": s, "char_end": s + len(content), "content": content, "section_path": path} for s, content, path in _cut(text, size, overlap)]


#: Characters of chunks that leave a task together; no more is held, however many chunks a batch of texts or one text has.
CHARS_TOGETHER = 1 << 20


def _markdown(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks out of rows of keys, text, size and overlap."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, (texts, sizes, overlaps) = batch.columns[:-3], batch.columns[-3:]
            rows: list[tuple[int, int, int, str, str | None]] = []
            chars = 0

            def made() -> pa.RecordBatch:
                row, index, start, content, path = zip(*rows, strict=True)
                ends = [s + len(c) for s, c in zip(start, content, strict=True)]
                columns = [*[k.take(pa.array(row, pa.int64())) for k in keys], pa.array(index), pa.array(start), pa.array(ends), pa.array(content), pa.array(path)]
                return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

            for k in range(batch.num_rows):
                for index, (start, content, path) in enumerate(_cut(texts[k].as_py() or "", sizes[k].as_py(), overlaps[k].as_py())):
                    rows.append((k, index, start, content, path))
                    chars += len(content) + 64  # and what a row costs
                    if chars >= CHARS_TOGETHER:
                        yield made()
                        rows, chars = [], 0
            if rows:
                yield made()

    return fn


def markdown_chunks(docs: DataFrame, text: str, size: int | Column, overlap: int | Column, keys: list[str]) -> DataFrame:
    """``cut_markdown`` of each row: ``chunk_index, char_start, char_end, content, section_path`` beside ``keys``."""
    size = (size if isinstance(size, Column) else F.lit(size)).cast("int")
    overlap = (overlap if isinstance(overlap, Column) else F.lit(overlap)).cast("int")
    rows = docs.select(*keys, F.col(text).alias("_text"), size.alias("_size"), overlap.alias("_overlap"))
    number, string = T.IntegerType(), T.StringType()
    found = {"chunk_index": number, "char_start": number, "char_end": number, "content": string, "section_path": string}
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-3]], *[T.StructField(k, t) for k, t in found.items()]])
    return rows.mapInArrow(_markdown(to_arrow_schema(schema)), schema)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Chunks of ``document_id, filename, content, strategy, chunk_size, chunk_overlap``.

    Adds ids, the filename as title and token estimates. The two strategies are separate plans over their
    own rows, so texts cut by size never go through Python.
    """
    keys = ["document_id", "filename", "content_type"]
    size, overlap = F.col("chunk_size"), F.col("chunk_overlap")
    fixed = fixed_windows(docs.where("strategy = 'fixed_size'"), "content", size, overlap, keys).withColumn("section_path", F.lit(None).cast("string"))
    marked = markdown_chunks(docs.where("strategy <> 'fixed_size'"), "content", size, overlap, keys)
    return fixed.unionByName(marked).select(
        "document_id", F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"), "chunk_index", "char_start", "char_end", "content",
        F.col("filename").alias("title"), "section_path", "content_type", estimate_tokens(F.col("content")).alias("token_estimate"),
    )


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """One edge from each chunk but a document's first, backwards.

    To the first chunk of its section, if that section occurred before (``same_section``), else to the chunk
    before (``next_chunk``). Edges are numbered within the document.
    """
    in_doc = Window.partitionBy("document_id").orderBy("chunk_index")
    in_section = Window.partitionBy("document_id", "section_path").orderBy("chunk_index")
    seen = F.col("section_path").isNotNull() & (F.row_number().over(in_section) > 1)
    rows = chunks.select(
        "document_id", "chunk_id", "chunk_index", F.lag("chunk_id").over(in_doc).alias("before"), seen.alias("seen"),
        F.first("chunk_id").over(in_section).alias("head"), (F.row_number().over(in_doc) - 2).alias("k"),
    )
    edges = rows.where(F.col("before").isNotNull())
    return edges.select(
        F.concat(F.col("document_id"), F.lit(":edge:"), F.col("k")).alias("edge_id"),
        F.col("chunk_id").alias("source_node_id"),
        F.when(F.col("seen"), F.col("head")).otherwise(F.col("before")).alias("target_node_id"),
        F.when(F.col("seen"), "same_section").otherwise("next_chunk").alias("relation_type"),
        F.lit(1.0).cast("float").alias("weight"),
        "document_id",
    )
