"""A kept inverted index: postings in blocks by term, added to on each change and searched by block maxima.

Every change is a segment of Parquet files that are never altered: ``chunks`` (keys and lengths), ``blocks`` (postings), ``terms`` (how
many chunks hold a term, as a difference) and ``dead`` (earlier chunks that it replaces). Segments of like size are merged, so there are
about as many as the logarithm of the number of changes. A chunk is known by its segment and its place in it; 128 places in a row are a range, and a
block holds one term's postings of one range with the greatest frequency and the least length of each field. Blocks and terms lie in folders by a hash of the term,
so a search opens only those of its terms, and their number grows with the rows.

No chunk of a range can score more for a query than the sum of what its blocks' maxima give. A search scores the few
best ranges of each query first; ranges whose bound is below the last place that these give are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.functions.analyze import plain_terms
from corvane.operators.lexical import DECIMALS, FIELDS, KEY, matches, top
from corvane.settings import Bm25Settings, Filters
from corvane.sources.shared import stored

RANGE_BITS = 7
#: Chunks of a segment for each of its folders, and the most folders.
CHUNKS_A_BUCKET, MOST_BUCKETS = 1 << 15, 1 << 12
#: Chunks of a segment for each part of a folder; a term in every chunk is dealt over so many tasks.
CHUNKS_A_PART, LEAST_PARTS = 1 << 22, 4
#: Terms up to which a search names its terms to the scan; more are joined.
NAMED_TERMS = 4096
#: A segment is merged with the one before if that has at most so many times its chunks.
MERGE_UP_TO = 2
#: Places up to which a search scores all ranges in one pass, as finding those to leave out would cost more.
FEW_PLACES = 1 << 17
#: Ranges that a search scores first at least.
FIRST_RANGES = 4
#: Chunks of a segment for each task that writes it, which sorts its part in memory.
CHUNKS_A_TASK = 1 << 14
#: Chunks whose blocks are made together in a task.
ROWS_TOGETHER = 1 << 10
#: Ranges up to which their dead places are sent to every executor, 32 bytes each.
FEW_RANGES = 1 << 19
#: What sums of doubles may differ by.
SLACK = 1e-6


def _length(f: str) -> str:
    return f"length_{f}"


def _tf(f: str) -> str:
    return f"tf_{f}"


def _hash() -> Column:
    """What deals terms into folders: Spark and Python both have it."""
    return F.crc32(F.col("term").cast("binary"))


def _buckets(n: int) -> int:
    """Folders of a segment of so many chunks."""
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * CHUNKS_A_BUCKET < n:
        buckets *= 2
    return buckets


def _lists(fields: tuple[str, ...]) -> list[str]:
    """The columns of a block's postings: lists of equal length, or null for a field that the term is not in."""
    return ["places", *[f"{x(f)}s" for f in fields for x in (_tf, _length)]]


def _packed(schema: T.StructType, fields: tuple[str, ...]) -> T.StructType:
    """Blocks of a folder that are shuffled as one row: each column as a list; the postings' lists one after the other, and where those of a block start."""
    lists, number = _lists(fields), T.ArrayType(T.IntegerType())
    heads = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema if f.name not in ("segment", *lists)]
    own = [T.StructField("_bucket", T.IntegerType()), T.StructField("_slab", T.LongType()), T.StructField("segment", T.IntegerType())]
    return T.StructType([*own, *heads, *[schema[x] for x in lists], T.StructField("_at", number), *[T.StructField(f"_at_{f}", number) for f in fields]])


def _unpacked(rows: DataFrame, schema: T.StructType, fields: tuple[str, ...]) -> DataFrame:
    """The blocks out of rows of many."""
    heads = [f.name for f in schema if f.name not in ("segment", *_lists(fields))]
    each = F.explode(F.arrays_zip(*heads, "_at", *[f"_at_{f}" for f in fields])).alias("z")
    out = rows.select("_bucket", "segment", *_lists(fields), each)
    cut = {"places": F.slice("places", F.col("z._at") + 1, F.col("z.n"))}
    for f in fields:
        for x in (_tf, _length):
            cut[f"{x(f)}s"] = F.when(F.col(f"z.most_{f}") > 0, F.slice(f"{x(f)}s", F.col(f"z._at_{f}") + 1, F.col("z.n")))
    return out.select("_bucket", *[F.col("segment") if c == "segment" else cut[c].alias(c) if c in cut else F.col(f"z.{c}") for c in schema.fieldNames()])


def _packing(made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: tuple[str, ...], buckets: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks that ``made`` gives at a time as a row for each of their folders."""

    lists = _lists(fields)
    starts = {"places": "_at"} | {f"{x(f)}s": f"_at_{f}" for f in fields for x in (_tf, _length)}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in made(batches):
            if not blocks.num_rows:
                continue
            words = blocks.column("term").dictionary_encode()
            folder = np.array([crc32(t.encode()) % buckets for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
            order = np.argsort(folder, kind="stable")
            first = np.flatnonzero(np.diff(folder[order], prepend=-1))
            blocks = blocks.take(pa.array(order))
            at = np.append(first, order.size)
            rows = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            columns = {"_bucket": pa.array(folder[order][first]), "_slab": pa.array(np.full(first.size, blocks.column("range")[0].as_py())), "segment": blocks.column("segment").take(pa.array(first))}
            for k in blocks.schema.names:
                if k == "segment":
                    continue
                if k not in lists:
                    columns[k] = rows(blocks.column(k), at)
                    continue
                sizes = blocks.column(k).value_lengths().fill_null(0).to_numpy()
                start = np.append(0, np.cumsum(sizes))
                columns[k] = rows(blocks.column(k).flatten(), start[at])
                # from the start of the row's own list
                columns[starts[k]] = rows(pa.array(start[:-1] - np.repeat(start[first], np.diff(at))), at)
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return packed


def _as_blocks(fields: tuple[str, ...], schema: pa.Schema, terms: pa.Array, segment: int, ranges: np.ndarray, start: np.ndarray, places: np.ndarray, tf: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Blocks of a segment out of postings that lie by block: each block's term, range and first posting, and each posting's place in the range and columns of frequencies and lengths by field."""
    ends = np.append(start, places.size)
    sizes = np.diff(ends)
    bounds, entries = [], [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places.astype(np.int8)))]
    for k in range(len(fields)):
        there = np.where(tf[:, k] > 0, length[:, k], np.iinfo(np.int64).max)
        most, least = (np.maximum.reduceat(tf[:, k], start), np.minimum.reduceat(there, start)) if start.size else (tf[:0, k], there[:0])
        bounds += [pa.array(most, pa.int32()), pa.array(np.where(most > 0, least, 0), pa.int32(), mask=most == 0)]
        # a block without the term in this field has no lists for it
        own = np.repeat(most > 0, sizes)
        ends_k = np.append(0, np.cumsum(np.where(most > 0, sizes, 0)))
        for x in (tf[:, k], length[:, k]):
            entries.append(pa.ListArray.from_arrays(pa.array(ends_k, pa.int32()), pa.array(x[own], pa.int32()), mask=pa.array(most == 0)))
    columns = [terms, pa.array(np.full(start.size, segment), pa.int32()), pa.array(ranges), pa.array(sizes, pa.int32()), *bounds, *entries]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _living(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting of a batch of blocks its block, its place in the range and whether its chunk still holds, by the bits ``_low`` and ``_high`` of the range's dead places."""
    lists = batch.column("places")
    places = lists.flatten().to_numpy().astype(np.int64)
    block = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    low, high = (batch.column(c).fill_null(0).to_numpy() for c in ("_low", "_high"))
    return block, places, np.where(places < 64, low[block], high[block]) >> (places & 63) & 1 == 0


def _values(lists: pa.Array, block: np.ndarray) -> np.ndarray:
    """The numbers of a block's list for each of its postings, 0 where the list is empty."""
    out = np.zeros(block.size, np.int64)
    out[lists.value_lengths().to_numpy(zero_copy_only=False)[block] > 0] = lists.flatten().to_numpy()
    return out


def _without_dead(fields: tuple[str, ...], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks without their dead postings, a segment's at a time. A block stays in its segment and range, and one of which nothing is left goes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("segment").to_numpy()
            for segment in np.unique(number):
                yield of(batch.filter(pa.array(number == segment)), int(segment))

    def of(batch: pa.RecordBatch, segment: int) -> pa.RecordBatch:
        block, places, living = _living(batch)
        tf, length = (np.stack([_values(batch.column(f"{x(f)}s"), block)[living] for f in fields], 1) for x in (_tf, _length))
        block, places = block[living], places[living]
        start = np.flatnonzero(np.diff(block, prepend=-1))
        left = pa.array(block[start])
        return _as_blocks(fields, schema, batch.column("term").take(left), segment, batch.column("range").take(left).to_numpy(), start, places, tf, length)

    return made


def _blocks_of(fields: tuple[str, ...], bits: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks out of ``segment, place`` and the fields' terms. A range whose rows come in two tasks has two blocks of a term, which a search adds up."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in (b.slice(k, ROWS_TOGETHER) for b in batches for k in range(0, b.num_rows, ROWS_TOGETHER)):
            ranges = batch.column("place").to_numpy() >> bits
            cut = int(np.flatnonzero(ranges != ranges[-1])[-1]) + 1 if (ranges != ranges[-1]).any() else 0
            if cut or waiting and waiting[-1].column("place")[0].as_py() >> bits != ranges[-1]:
                yield of(pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks())
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield of(pa.Table.from_batches(waiting).combine_chunks())

    def of(rows: pa.Table) -> pa.RecordBatch:
        place = rows.column("place").to_numpy()
        lists = [rows.column(f).combine_chunks() for f in fields]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        length = np.stack([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists], 1).astype(np.int64)
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        size = max(1, len(words.dictionary))
        row = np.concatenate([np.repeat(np.arange(len(place)), n) for n in length.T])
        field = np.repeat(np.arange(len(fields)), length.sum(0))
        pair, which = np.unique(row * size + words.indices.to_numpy(), return_inverse=True)
        tf = np.bincount(which * len(fields) + field, minlength=pair.size * len(fields)).reshape(-1, len(fields))
        row, word = pair // size, pair % size
        own = place[row] >> bits
        order = np.lexsort((place[row], word, own))
        row, word, own, tf = row[order], word[order], own[order], tf[order]
        start = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
        return _as_blocks(fields, schema, words.dictionary.take(pa.array(word[start])), rows.column("segment")[0].as_py(), own[start], start, place[row] & (1 << bits) - 1, tf, length[row])

    return made


class InvertedIndex:
    """The index as of one moment. ``entry`` says which segments it has, as JSON; a change gives another index and leaves this one as it is."""

    def __init__(self, spark: SparkSession, root: str, entry: dict | None = None, analyzer: Callable[[Column], Column] = plain_terms, fields: tuple[str, ...] = FIELDS):
        self.spark, self.root, self.analyzer, self.fields = spark, root.rstrip("/"), analyzer, fields
        self.segments: list[dict] = list((entry or {}).get("segments", []))

    @property
    def entry(self) -> dict:
        return {"segments": self.segments}

    @classmethod
    def build(cls, spark: SparkSession, root: str, chunks: DataFrame, analyzer: Callable[[Column], Column] = plain_terms, fields: tuple[str, ...] = FIELDS) -> InvertedIndex:
        """An index of ``chunks`` (the key, ``content_type`` and the fields)."""
        return cls(spark, root, None, analyzer, fields).changed(chunks)

    # schemas

    def _kept(self) -> list[T.StructField]:
        return [T.StructField("segment", T.IntegerType()), T.StructField("place", T.LongType()), *[T.StructField(_length(f), T.IntegerType()) for f in self.fields]]

    def _schema(self, kind: str) -> T.StructType:
        long, number, text = T.LongType(), T.IntegerType(), T.StringType()
        if kind == "chunks":
            keys = {"document_id": text, "chunk_index": number, "chunk_id": text, "content_type": text}
            return T.StructType([*[T.StructField(k, t) for k, t in keys.items()], *self._kept()])
        if kind == "terms":
            return T.StructType([T.StructField("term", text), T.StructField("df", long)])
        if kind == "dead":
            return T.StructType([T.StructField("segment", number), T.StructField("place", long)])
        bounds = [T.StructField(f"{x}_{f}", number) for f in self.fields for x in ("most", "least")]
        return T.StructType([T.StructField("term", text), T.StructField("segment", number), T.StructField("range", long), T.StructField("n", number), *bounds, *[T.StructField(x, T.ArrayType(T.ByteType() if x == "places" else number)) for x in _lists(self.fields)]])

    # reading

    def _read(self, kind: str, segments: list[dict] | None = None, hashes: list[int] | None = None) -> DataFrame:
        """A table of these segments; with ``hashes`` of terms only the folders of those."""
        paths = []
        for s in self.segments if segments is None else segments:
            if kind in ("blocks", "terms"):
                wanted = None if hashes is None else {h % s["buckets"] for h in hashes}
                paths += [f"{s['folder']}/{kind}/_bucket={b}" for b in s[kind] if wanted is None or b in wanted]
            elif kind == "chunks" or s["dead"]:
                paths.append(f"{s['folder']}/{kind}")
        schema = self._schema(kind)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        """Keys, type and field lengths of the chunks that hold."""
        return self._read("chunks").join(self._read("dead"), ["segment", "place"], "left_anti")

    def statistics(self) -> tuple[int, dict[str, float]]:
        """Chunks and the average length of each field, at least 1."""
        n = sum(s["chunks"] for s in self.segments)
        return n, {f: max(1.0, sum(s["lengths"][f] for s in self.segments) / max(1, n)) for f in self.fields}

    def frequencies(self) -> DataFrame:
        """``term, df``: chunks that hold a term in any field."""
        return self._read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def postings(self) -> DataFrame:
        """``segment, place, term`` and each field's frequency and length, of the chunks that hold."""
        rows = self._read("blocks").select("segment", "term", self._entries()).select("segment", "term", "e.*")
        return rows.join(self._read("dead"), ["segment", "place"], "left_anti")

    def totals(self) -> DataFrame:
        """``term, n_chunks``: chunks that hold and have the term, and ``in_<field>``: its places in each field. Postings are added up within their block."""
        rows = self._marked(self._read("blocks").select("term", "segment", "range", "n", "places", *[f"{_tf(f)}s" for f in self.fields]))
        rows = rows.withColumn("_living", F.expr("transform(places, p -> 1 - cast(shiftright(if(p < 64, _low, _high), cast(p as int) & 63) & 1L as int))"))
        plus = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
        none = F.col("_low").isNull()
        sums = [F.when(F.size(tf) == 0, 0).when(none, plus(F.col(tf))).otherwise(plus(F.zip_with(tf, "_living", lambda a, b: a * b))).alias(f"in_{f}") for f, tf in ((f, f"{_tf(f)}s") for f in self.fields)]
        each = rows.select("term", F.when(none, F.col("n")).otherwise(plus(F.col("_living"))).alias("n_chunks"), *sums)
        return each.groupBy("term").agg(*[F.sum(c).alias(c) for c in each.columns[1:]]).where("n_chunks > 0")

    def _marked(self, blocks: DataFrame) -> DataFrame:
        """Blocks with the dead places of their range as bits, ``_low`` those below 64 and ``_high`` the others: a row for each range that has some.

        Lists that are null come as empty ones: Arrow's writer walks back over all nulls before a row to learn its batch's size, so a batch of them takes their square.
        """
        place, bit = F.col("place").bitwiseAND(F.lit((1 << RANGE_BITS) - 1)), F.expr(f"shiftleft(1L, cast(place & {(1 << RANGE_BITS) - 1} as int) & 63)")
        bits = lambda which: F.coalesce(F.bit_or(F.when(which, bit)), F.lit(0).cast("long"))
        gone = self._read("dead").groupBy("segment", F.shiftright("place", RANGE_BITS).alias("range")).agg(bits(place < 64).alias("_low"), bits(place >= 64).alias("_high"))
        full = {c: F.coalesce(c, F.array().cast("array<int>")) for c in blocks.columns if c in _lists(self.fields)[1:]}
        blocks = blocks.withColumns(full) if full else blocks
        few = sum(s["places"] for s in self.segments) >> RANGE_BITS <= FEW_RANGES
        return blocks.join(F.broadcast(gone) if few else gone, ["segment", "range"], "left")

    def _entries(self) -> Column:
        """A row ``e`` for each posting of a block: its place, and each field's frequency and length, 0 where the term is not in it."""
        at = lambda x, k: F.coalesce(F.get(x, k), F.lit(0))
        place = lambda p: (F.shiftleft("range", RANGE_BITS) + p).alias("place")
        entry = lambda p, k: F.struct(place(p), *[at(f"{x(f)}s", k).alias(x(f)) for f in self.fields for x in (_tf, _length)])
        return F.explode(F.transform("places", entry)).alias("e")

    # writing

    def _folders(self, path: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket="))

    def _write_by_term(self, rows: DataFrame, kind: str, folder: str, buckets: int, spread: Column, parts: int, order: list[str], n: int) -> list[int]:
        """Rows in the folders of their terms, sorted, each folder dealt over ``parts`` tasks by ``spread``. Folders and parts are numbered and not hashed anew, so no task has several by chance."""
        packed = "_slab" in rows.columns
        rows = rows if packed else rows.withColumn("_bucket", (_hash() % buckets).cast("int"))
        tasks = min(buckets * parts, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), n // CHUNKS_A_TASK))
        dealt = rows.repartitionById(tasks, ((F.col("_bucket") * parts + spread) % tasks).cast("int"))
        dealt = _unpacked(dealt, self._schema(kind), self.fields) if packed else dealt
        dealt.sortWithinPartitions("_bucket", *order).write.partitionBy("_bucket").parquet(f"{folder}/{kind}")
        return self._folders(f"{folder}/{kind}")

    def _written(self, folder: str, number: int, covers: list[int], n: int, blocks: DataFrame, terms: Callable[[DataFrame], DataFrame], has_dead: bool) -> dict:
        buckets = _buckets(n)
        parts = max(LEAST_PARTS, -(-n // CHUNKS_A_PART))
        segment = {"number": number, "covers": covers, "folder": folder, "buckets": buckets, "places": n, "dead": has_dead, "terms": []}
        place = "_slab" if "_slab" in blocks.columns else "range"
        segment["blocks"] = self._write_by_term(blocks, "blocks", folder, buckets, F.pmod(F.xxhash64(place), F.lit(parts)), parts, ["term", "segment", "range"], n)
        own = terms(self._read("blocks", [segment]).select("term", "n"))
        segment["terms"] = self._write_by_term(own, "terms", folder, buckets, F.lit(0), 1, ["term"], n)
        return segment

    def changed(self, new: DataFrame, replaced: DataFrame | None = None) -> InvertedIndex:
        """The index after the chunks ``replaced``, as they were indexed, gave way to ``new``. What this index reads stays as it is."""
        number = 1 + max((c for s in self.segments for c in s["covers"]), default=0)
        folder = f"{self.root}/{number}-{uuid.uuid4().hex}"
        kind = F.col("content_type").cast("string") if "content_type" in new.columns else F.lit(None).cast("string")
        keys = [F.col("document_id").cast("string").alias("document_id"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("chunk_id").cast("string").alias("chunk_id")]
        places = new.select(*keys, kind.alias("content_type"), *[self.analyzer(F.col(f)).alias(f) for f in self.fields])
        # numbered once and read back, so a place never changes
        tok = stored(places.select("*", F.lit(number).alias("segment"), F.monotonically_increasing_id().alias("place")), "index-tokens")
        tok.select(*KEY, "content_type", "segment", "place", *[F.size(f).alias(_length(f)) for f in self.fields]).write.parquet(f"{folder}/chunks")
        sums = lambda df: df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(_length(f)), F.lit(0)).alias(f) for f in self.fields]).first()
        added = sums(self.spark.read.schema(self._schema("chunks")).parquet(f"{folder}/chunks"))

        # the places of a range follow each other in a file, so its blocks are made where they are read
        made, packed = _blocks_of(self.fields, RANGE_BITS, to_arrow_schema(self._schema("blocks"))), _packed(self._schema("blocks"), self.fields)
        blocks = tok.select("segment", "place", *self.fields).mapInArrow(_packing(made, self.fields, _buckets(added["n"]), to_arrow_schema(packed)), packed)

        gone = None
        if replaced is not None and self.segments:
            gone = stored(self.chunks().join(replaced.select(F.col("chunk_id").cast("string").alias("chunk_id")), "chunk_id", "left_semi"), "index-gone")
            gone.select("segment", "place").write.parquet(f"{folder}/dead")

        def terms(of: DataFrame) -> DataFrame:
            df = of.select("term", F.col("n").cast("long").alias("df"))
            if gone is not None:
                words = F.array_distinct(F.concat(*[self.analyzer(F.col(f)) for f in self.fields]))
                old = replaced.join(gone.select("chunk_id"), "chunk_id", "left_semi").select(F.explode(words).alias("term"), F.lit(-1).cast("long").alias("df"))
                df = df.unionByName(old)
            return df.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")

        segment = self._written(folder, number, [number], added["n"], blocks, terms, gone is not None)
        lost = sums(gone) if gone is not None else None
        segment["chunks"] = added["n"] - (lost["n"] if lost else 0)
        segment["lengths"] = {f: int(added[f]) - int(lost[f] if lost else 0) for f in self.fields}
        out = InvertedIndex(self.spark, self.root, {"segments": [*self.segments, segment]}, self.analyzer, self.fields)
        while len(out.segments) > 1 and out.segments[-2]["places"] <= MERGE_UP_TO * out.segments[-1]["places"]:
            out = out._merged(2)
        return out

    def _merged(self, last: int) -> InvertedIndex:
        """The last segments as one, without their dead chunks. Nothing is cut into terms anew."""
        parts = self.segments[-last:]
        covers = sorted(c for s in parts for c in s["covers"])
        folder = f"{self.root}/{covers[-1]}-{uuid.uuid4().hex}"
        every = self._read("dead")
        chunks = self._read("chunks", parts).join(every, ["segment", "place"], "left_anti")
        chunks.write.parquet(f"{folder}/chunks")
        n = self.spark.read.schema(self._schema("chunks")).parquet(f"{folder}/chunks").count()
        kept = [s for s in parts if s["dead"]]
        earlier = self._read("dead", kept).where(~F.col("segment").isin(covers)) if kept else None
        if earlier is not None:
            earlier.write.parquet(f"{folder}/dead")
        arrow, packed = to_arrow_schema(self._schema("blocks")), _packed(self._schema("blocks"), self.fields)
        blocks = self._marked(self._read("blocks", parts)).mapInArrow(_packing(_without_dead(self.fields, arrow), self.fields, _buckets(n), to_arrow_schema(packed)), packed)
        terms = self._read("terms", parts)
        segment = self._written(folder, covers[-1], covers, n, blocks, lambda _: terms.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), earlier is not None)
        segment["chunks"] = sum(s["chunks"] for s in parts)
        segment["lengths"] = {f: sum(s["lengths"][f] for s in parts) for f in self.fields}
        return InvertedIndex(self.spark, self.root, {"segments": [*self.segments[:-last], segment]}, self.analyzer, self.fields)

    # searching

    def _weighted(self, s: Bm25Settings, tf: Callable[[str], Column], length: Callable[[str], Column]) -> Column:
        """What a term adds to a chunk's score, over its inverse document frequency."""
        _, average = self.statistics()
        boosts = {"content": s.content_boost, "title": s.title_boost, "section_path": s.section_boost}
        total = F.lit(0.0)
        for f in self.fields:
            value = float(boosts[f]) * (tf(f) * (s.k1 + 1)) / (tf(f) + s.k1 * (1 - s.b + s.b * length(f) / average[f]))
            total = total + F.when(tf(f) > 0, value).otherwise(0.0)
        return total

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, list[int] | None, list[str] | None]:
        """``query_id, term, idf`` of terms that some chunk holds; hashes and terms if they are few enough to be named."""
        n, _ = self.statistics()
        asked = queries.select("query_id", F.explode(F.array_distinct(self.analyzer(F.col("text")))).alias("term"))
        found = asked.select("term").distinct().select("term", _hash().alias("h")).limit(NAMED_TERMS + 1).collect()
        few = len(found) <= NAMED_TERMS
        hashes, names = ([r["h"] for r in found], [r["term"] for r in found]) if few else (None, None)
        own = self._read("terms", hashes=hashes)
        own = own.where(F.col("term").isin(names)) if few else own.join(asked.select("term").distinct(), "term", "left_semi")
        df = own.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return stored(asked.join(df, "term").select("query_id", "term", idf.alias("idf")), "weighted"), hashes, names

    def _blocks(self, hashes: list[int] | None, names: list[str] | None) -> DataFrame:
        rows = self._read("blocks", hashes=hashes)
        return rows.where(F.col("term").isin(names)) if names is not None else rows

    def ranges(self, asked: DataFrame, blocks: DataFrame, s: Bm25Settings) -> DataFrame:
        """``query_id, segment, range``: ``bound``, above which no chunk of the range scores, the number of ``blocks``, and ``best`` from 1 by bound."""
        bound = self._weighted(s, lambda f: F.col(f"most_{f}"), lambda f: F.col(f"least_{f}")) * F.col("idf")
        rows = blocks.drop(*_lists(self.fields)).join(asked, "term").groupBy("query_id", "segment", "range").agg(F.sum(bound).alias("bound"), F.count("*").alias("blocks"))
        return rows.withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")))

    def _scores(self, asked: DataFrame, blocks: DataFrame, chosen: DataFrame | None, s: Bm25Settings, allowed: DataFrame | None) -> DataFrame:
        """The chunks of the chosen ranges (``query_id, segment, range``), or of all, with their whole scores."""
        if chosen is None:
            rows = blocks.select("term", "segment", "range", *_lists(self.fields)).join(asked, "term")
        else:
            wanted = chosen.select("query_id", "segment", "range").join(asked, "query_id")
            rows = blocks.select("term", "segment", "range", *_lists(self.fields)).join(wanted, ["term", "segment", "range"])
        rows = rows.select("query_id", "segment", "idf", self._entries()).select("query_id", "segment", "idf", "e.*")
        if allowed is not None:
            rows = rows.join(allowed, ["segment", "place"], "left_semi")
        elif any(x["dead"] for x in self.segments):
            rows = rows.join(self._read("dead"), ["segment", "place"], "left_anti")
        value = self._weighted(s, lambda f: F.col(_tf(f)), lambda f: F.col(_length(f))) * F.col("idf")
        return rows.groupBy("query_id", "segment", "place").agg(F.round(F.sum(value), DECIMALS).alias("score")).where("score > 0")

    def chosen(self, asked: DataFrame, blocks: DataFrame, limit: int, s: Bm25Settings, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The ranges with ``read``: whether a search scores them; and the scores of those that it scores."""
        ranges = stored(self.ranges(asked, blocks, s), "ranges")
        first = F.col("best") <= max(FIRST_RANGES, limit)  # the best chunks may all lie in ranges of their own
        scores = stored(self._scores(asked, blocks, ranges.where(first), s, allowed), "first-scores")
        last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        floor = scores.withColumn("_n", last).where(F.col("_n") == limit).select("query_id", F.col("score").alias("floor"))
        judged = ranges.join(floor, "query_id", "left").withColumn("read", first | (F.col("bound") + SLACK >= F.coalesce("floor", F.lit(0.0))))
        rest = self._scores(asked, blocks, judged.where(F.col("read") & ~first), s, allowed)
        return judged.drop("floor"), scores.unionByName(rest)

    def _allowed(self, filters: Filters | None) -> DataFrame | None:
        if not filters or not (filters.document_ids or filters.content_types):
            return None
        return stored(self.chunks().where(matches(filters)).select("segment", "place"), "allowed")

    def search(self, queries: DataFrame, limit: int, filters: Filters | None = None, settings: Bm25Settings | None = None) -> DataFrame:
        """Top chunks of each query (``query_id, text``) as ``lexical.search`` gives them: ``query_id``, the key, ``score`` and ``rank``.

        Filters act on the rows alone, never on the statistics. A query of no term, or of terms that no chunk holds, has no row.
        """
        s = settings or Bm25Settings()
        asked, hashes, names = self._asked(queries)
        blocks, allowed = self._blocks(hashes, names), self._allowed(filters)
        if sum(x["places"] for x in self.segments) <= FEW_PLACES:
            scores = self._scores(asked, blocks, None, s, allowed)
        else:
            _, scores = self.chosen(asked, blocks, limit, s, allowed)
        # with ties at the last place, whose order the keys decide
        near = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        best = stored(scores.withColumn("_r", near).where(F.col("_r") <= limit).drop("_r"), "best-scores")
        return top(best.join(self._read("chunks"), ["segment", "place"]).select("query_id", *KEY, "score"), limit)

    def skipped(self, queries: DataFrame, limit: int, filters: Filters | None = None, settings: Bm25Settings | None = None) -> DataFrame:
        """Of each query the ``blocks`` of its terms and how many a search leaves unread, ``skipped``."""
        s = settings or Bm25Settings()
        asked, hashes, names = self._asked(queries)
        judged, _ = self.chosen(asked, self._blocks(hashes, names), limit, s, self._allowed(filters))
        return judged.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(~F.col("read"), F.col("blocks")).otherwise(0)).alias("skipped"))

