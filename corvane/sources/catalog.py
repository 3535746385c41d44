"""A store of Parquet tables with snapshots.

A manifest lists, for each table, the folder of each bucket of its rows. Writers put new folders
beside the old ones and then add the next manifest, which takes effect for all tables at once; a
writer that fails before leaves the store as it was. Readers keep the snapshot that they opened.
A change by key rewrites only the buckets of its keys.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.errors import InvalidDocument, MissingTable, QueueFull, SchemaDrift, WriteNotSeen
from corvane.functions.analyze import plain_terms
from corvane.operators.state import next_generation
from corvane.sources.index import InvertedIndex
from corvane.sources.schemas import BUCKETED_BY, LEGACY_STAGED, SCHEMAS
from corvane.sources.shared import stored

BUCKETS, SPREAD = 64, 4
#: Bytes of a bucket from which a table is dealt into twice as many, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 1 << 16


class Store:
    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), manifest
        #: Called with a table's name before its new folders are written; tests make it fail.
        self.before_write: Callable[[str], None] = lambda name: None
        #: Of the kept index.
        self.analyzer: Callable[[Column], Column] = plain_terms

    # opening

    @classmethod
    def initialise(cls, spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
        """Open the store, creating the tables that are missing and migrating a legacy staged table."""
        store = cls(spark, root, {"version": 0, "buckets": buckets, "tables": {}})
        if latest := store._latest():
            store.manifest = latest
        tables = dict(store.manifest["tables"])
        for name, schema in SCHEMAS.items():
            if name not in tables:
                tables[name] = {"schema": schema.jsonValue(), "parts": {}}
        store._migrate(tables)
        if tables != store.manifest["tables"]:
            store._commit(tables)
        store.validate()
        return store

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """Open for reading; a missing table or a schema that isn't the declared one is an error. Nothing is changed."""
        store = cls(spark, root, {})
        latest = store._latest()
        if not latest:
            raise MissingTable(f"{root} holds no store")
        store.manifest = latest
        store.validate()
        return store

    def validate(self) -> None:
        for name, schema in SCHEMAS.items():
            if name not in self.manifest["tables"]:
                raise MissingTable(f"table {name} is missing")
            if T.StructType.fromJson(self.manifest["tables"][name]["schema"]) != schema:
                raise SchemaDrift(f"table {name} has another schema than declared")

    def _migrate(self, tables: dict) -> None:
        staged = tables["staged_documents"]
        if T.StructType.fromJson(staged["schema"]) == LEGACY_STAGED:
            old = self._frame(LEGACY_STAGED, staged["parts"])
            rows = old.withColumn("generation", F.lit(1).cast("long"))
            tables["staged_documents"] = {"schema": SCHEMAS["staged_documents"].jsonValue(), "parts": self._write("staged_documents", rows)}

    # files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _latest(self) -> dict | None:
        folder, fs = self._fs(f"{self.root}/_manifests")
        if not fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        text = self.spark.read.text(f"{self.root}/_manifests/{names[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, tables: dict, index: dict | None = None) -> None:
        """Add the next manifest. If another writer has added it, this one's change is void."""
        manifest = {**self.manifest, "version": self.manifest["version"] + 1, "tables": tables}
        if index is not None:
            manifest["index"] = index
        target, fs = self._fs(f"{self.root}/_manifests/{manifest['version']:012d}.json")
        draft, _ = self._fs(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError("another writer has changed the store; open it anew and repeat")
        self.manifest = manifest

    # reading

    def _frame(self, schema: T.StructType, parts: dict[str, str]) -> DataFrame:
        paths = sorted(set(parts.values()))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        if name not in self.manifest["tables"]:
            raise MissingTable(f"table {name} is missing")
        return self._frame(SCHEMAS[name], self.manifest["tables"][name]["parts"])

    def count(self, name: str, condition: str | None = None) -> int:
        rows = self.table(name)
        return (rows.where(condition) if condition else rows).count()

    # the kept index

    def index(self, analyzer: Callable[[Column], Column] = plain_terms) -> InvertedIndex | None:
        """The index of this snapshot's chunks, if the store keeps one. The analyzer is the one that it was enabled with."""
        entry = self.manifest.get("index")
        return InvertedIndex(self.spark, f"{self.root}/_index", entry, analyzer) if entry is not None else None

    def enable_index(self, analyzer: Callable[[Column], Column] = plain_terms) -> None:
        """Index the chunks that there are; from now on each replacement of documents changes the index in the same commit."""
        self.analyzer = analyzer
        self._commit(self.manifest["tables"], InvertedIndex.build(self.spark, f"{self.root}/_index", self.table("nodes"), analyzer).entry)

    # writing

    def _buckets(self, name: str) -> int:
        return self.manifest["tables"].get(name, {}).get("buckets", self.manifest["buckets"])

    def _bucket(self, name: str, buckets: int | None = None):
        return F.pmod(F.xxhash64(BUCKETED_BY[name]), F.lit(buckets or self._buckets(name))).cast("int")

    def _wanted_buckets(self, name: str) -> int:
        """As many buckets as the table has, or twice as many again and again until they are small."""
        size = 0
        for folder in set(self.manifest["tables"][name]["parts"].values()):
            path, fs = self._fs(folder)
            size += fs.getContentSummary(path).getLength()
        buckets = self._buckets(name)
        while buckets < MOST_BUCKETS and size > buckets * BUCKET_BYTES:
            buckets *= 2
        return buckets

    def _write(self, name: str, rows: DataFrame, buckets: int | None = None) -> dict[str, str]:
        """Write rows as new folders, one a bucket, and return those."""
        self.before_write(name)
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        required = [f.name for f in SCHEMAS[name].fields if not f.nullable]
        complete = rows
        for f in SCHEMAS[name].fields:
            value = F.col(f.name) if f.name in rows.columns else F.lit(None)
            complete = complete.withColumn(f.name, value.cast(f.dataType))
        checked = complete.select(*SCHEMAS[name].fieldNames())
        for c in required:
            checked = checked.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{name}.{c} is null"))).otherwise(F.col(c)))
        # a few files for each bucket; a large one is dealt over as many tasks
        spread = F.pmod(F.xxhash64(*SCHEMAS[name].fieldNames()[:2]), F.lit(SPREAD))
        dealt = checked.withColumn("_bucket", self._bucket(name, buckets)).repartition("_bucket", spread)
        dealt.write.partitionBy("_bucket").parquet(folder)
        path, fs = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in names}

    def _touched(self, name: str, keys: DataFrame) -> dict[str, str]:
        """The folders of the buckets in which these keys are."""
        buckets = {str(r[0]) for r in keys.distinct().toDF(BUCKETED_BY[name]).select(self._bucket(name)).distinct().collect()}
        return {b: p for b, p in self.manifest["tables"][name]["parts"].items() if b in buckets}

    def _rewritten(self, name: str, keys: DataFrame, new: DataFrame, key: str | None = None, counts: tuple[Observation, Observation] | None = None) -> dict:
        """The table's entry after the rows of ``keys`` gave way to ``new``.

        With the bucketing column as key only the buckets of these keys are read and written; with another one, or when the table has outgrown its buckets, all are. ``counts`` get ``n``, the rows that went and those that came, from the job that writes.
        """
        entry, key = self.manifest["tables"][name], key or BUCKETED_BY[name]
        parts, fields = entry["parts"], SCHEMAS[name].fields
        buckets = self._wanted_buckets(name)
        some = key == BUCKETED_BY[name] and buckets == self._buckets(name)
        touched = self._touched(name, keys.select(key).union(new.select(key))) if some else dict(parts)
        own = new.select(*[F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        gone = new.select(key).union(keys.select(key)).distinct().withColumn("_gone", F.lit(True))
        old = self._frame(SCHEMAS[name], touched).join(gone, key, "left")
        if counts:
            old, own = old.observe(counts[0], F.count("_gone").alias("n")), own.observe(counts[1], F.count(F.lit(1)).alias("n"))
        written = self._write(name, old.where("_gone is null").select(own.columns).unionByName(own), buckets)
        return {**entry, "buckets": buckets, "parts": {**{b: p for b, p in parts.items() if b not in touched}, **written}}

    def _change(self, **entries: dict) -> None:
        self._commit({**self.manifest["tables"], **entries})

    def stage(self, new: DataFrame, capacity: int | None = None) -> None:
        """Stage uploads, each with the generation after its document's last one, which it replaces.

        More than ``capacity`` documents waiting is an error before anything is written; so is a row that is written and not found again, before it counts.
        """
        rows = stored(next_generation(new, self.table("staged_documents")), "staged")
        if capacity is not None:
            waiting = self.table("staged_documents").select("document_id").union(rows.select("document_id")).distinct().count()
            if waiting > capacity:
                raise QueueFull(f"{waiting} documents would wait, more than {capacity}")
        entry = self._rewritten("staged_documents", new.select("document_id"), rows)
        seen = self._frame(SCHEMAS["staged_documents"], entry["parts"])
        lost = rows.select("document_id", "generation").exceptAll(seen.select("document_id", "generation")).first()
        if lost:
            raise WriteNotSeen(f"generation {lost['generation']} of document {lost['document_id']} was not found after it was written")
        self._change(staged_documents=entry)

    def unstage(self, ids: DataFrame) -> None:
        self._change(staged_documents=self._rewritten("staged_documents", ids.select("document_id"), self.spark.createDataFrame([], SCHEMAS["staged_documents"])))

    def replace_documents(self, docs: DataFrame, chunks: DataFrame, edges: DataFrame, now: int = 0, model: str = "none") -> None:
        """Replace documents with their chunks and chunk edges and clear their staging, all in one commit.

        A document without chunks keeps only its own row. Entities and their edges stay.
        """
        ids = docs.select("document_id")
        constants = {"token_estimate_scheme": "words", "token_estimate_version": "1", "chunker_version": "1"}
        full = chunks.withColumns({k: F.lit(v) for k, v in constants.items()}).withColumn("content_hash", F.sha2("content", 256))
        for name, value in (("embedding", F.array().cast("array<float>")), ("embedding_model", F.lit(model)), ("ingested_at", F.lit(now).cast("long"))):
            if name not in full.columns:
                full = full.withColumn(name, value)
        entries = {
            "edges": self._rewritten("edges", ids, edges),
            "nodes": self._rewritten("nodes", ids, full),
            "documents": self._rewritten("documents", ids, docs),
            "staged_documents": self._rewritten("staged_documents", ids, self.spark.createDataFrame([], SCHEMAS["staged_documents"])),
        }
        index = self.index(self.analyzer)
        if index is not None:
            written = {b: p for b, p in entries["nodes"]["parts"].items() if self.manifest["tables"]["nodes"]["parts"].get(b) != p}
            new = self._frame(SCHEMAS["nodes"], written).join(ids, "document_id", "left_semi")
            old = self._frame(SCHEMAS["nodes"], self._touched("nodes", ids)).join(ids, "document_id", "left_semi")
            index = index.changed(new, old)
        self._commit({**self.manifest["tables"], **entries}, index.entry if index is not None else None)

    def upsert_graph(self, document_ids: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[int, int]:
        """Replace the entities given and all entity edges of the documents, in one commit. Returns the documents' edges before and after.

        Entities of earlier versions of a document stay, as others may refer to them. Edges that are written and not found again are an error; the store is then as before.
        """
        ends = edges.select(F.explode(F.array("source_node_id", "target_node_id")).alias("entity_id")).distinct()
        known = self.table("entities").select("entity_id").union(entities.select("entity_id"))
        stray = ends.join(known, "entity_id", "left_anti").first()
        if stray:
            raise InvalidDocument(f"edge end {stray['entity_id']} is no entity")
        counts = Observation(), Observation()
        entry = self._rewritten("entity_edges", document_ids, edges, counts=counts)
        prior, expected = (o.get["n"] for o in counts)
        written = self._frame(SCHEMAS["entity_edges"], entry["parts"]).join(document_ids, "document_id", "left_semi").count()
        # tasks that ran twice count twice, so what differs is counted anew
        if written != expected and written != (expected := edges.count()):
            raise WriteNotSeen(f"{written} entity edges were found of {expected} written")
        self._change(entities=self._rewritten("entities", entities.select("entity_id"), entities), entity_edges=entry)
        return prior, written
