import pytest

from corvane.errors import InvalidDocument, MissingTable, SchemaDrift
from corvane.operators import state
from corvane.plans import workflow
from corvane.sources.catalog import Store
from corvane.sources.schemas import LEGACY_STAGED


def test_terminal_status_absorbs(spark):
    rows = [("a", "queued", 1, 1), ("a", "processing", 2, 2), ("a", "failed", 3, 3), ("a", "completed", 4, 4), ("b", "queued", 1, 5), ("b", "processing", 1, 6)]
    u = spark.createDataFrame(rows, "document_id string, status string, at int, seq int")
    got = {r.document_id: r.status for r in state.latest_status(u).collect()}
    assert got == {"a": "failed", "b": "processing"}
    again = state.merge_status(state.latest_status(u.where("seq % 2 = 0")), u)
    assert {r.document_id: r.status for r in again.collect()} == got


def test_staged_generations(spark):
    s = spark.createDataFrame([("d", 1, "v1"), ("d", 2, "v2"), ("e", 1, "x")], "document_id string, generation long, filename string")
    assert {r.document_id: r.filename for r in state.check_staged(s).collect()} == {"d": "v2", "e": "x"}
    new = spark.createDataFrame([("d",), ("f",)], "document_id string")
    assert {r.document_id: r.generation for r in state.next_generation(new, s).collect()} == {"d": 3, "f": 1}
    with pytest.raises(InvalidDocument):
        state.check_staged(s.union(s.where("generation = 2")))


STAGED = "document_id string, filename string, raw_content binary, chunk_strategy string, chunk_size int, chunk_overlap int"


def staged(spark, *docs):
    return spark.createDataFrame([(i, f"{i}.txt", bytearray(t.encode()), "fixed_size", 40, 4) for i, t in docs], STAGED)


def test_store_replaces_and_rolls_back(spark, tmp_path):
    store = Store.initialise(spark, str(tmp_path / "s"), buckets=4)
    text = "Alice Smith met Bob Jones in the old town of Rome. Bob Jones left."
    store.stage(staged(spark, ("d", text), ("e", "")))
    store.stage(staged(spark, ("d", text)))
    assert {r.document_id: r.generation for r in store.table("staged_documents").collect()} == {"d": 2, "e": 1}
    workflow.ingest(store, store.table("staged_documents"))
    counts = {n: store.count(n) for n in ("documents", "nodes", "edges", "entities", "entity_edges", "staged_documents")}
    assert counts["documents"] == 2 and counts["nodes"] == 2 and counts["edges"] == 1 and counts["staged_documents"] == 0 and counts["entities"] > 0
    store.stage(staged(spark, ("d", text)))
    workflow.ingest(store, store.table("staged_documents"))
    assert {n: store.count(n) for n in counts} == counts

    reader, version = Store.open(spark, store.root), store.manifest["version"]

    def fail(name):
        if name == "documents":
            raise OSError("disk")

    store.before_write = fail
    with pytest.raises(OSError):
        store.replace_documents(spark.createDataFrame([("d", bytearray(b"x"))], "document_id string, raw_content binary"), store.table("nodes").limit(0), store.table("edges").limit(0))
    assert Store.open(spark, store.root).manifest["version"] == version and reader.count("nodes") == counts["nodes"]


def test_store_fails_closed(spark, tmp_path):
    with pytest.raises(MissingTable):
        Store.open(spark, str(tmp_path / "none"))
    store = Store.initialise(spark, str(tmp_path / "s"), buckets=2)
    tables = dict(store.manifest["tables"])
    legacy = {"schema": LEGACY_STAGED.jsonValue(), "parts": {}}
    store._commit({**tables, "staged_documents": legacy})
    with pytest.raises(SchemaDrift):
        Store.open(spark, store.root)
    assert Store.initialise(spark, store.root).count("staged_documents") == 0


def test_buckets_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from corvane.sources import catalog

    store = catalog.Store.initialise(spark, str(tmp_path / "s"), buckets=2)
    docs = lambda ids: spark.createDataFrame([(f"d{k}", b"x" * 100) for k in ids], "document_id string, raw_content binary")
    none = [spark.createDataFrame([], store.table(t).schema) for t in ("nodes", "edges")]
    chunks, edges = none[0].drop("content_hash", "token_estimate_scheme", "token_estimate_version", "chunker_version", "embedding", "embedding_model", "ingested_at"), none[1]
    store.replace_documents(docs(range(40)), chunks, edges)
    before = set(store.manifest["tables"]["documents"]["parts"].values())
    assert len(before) == 2
    store.replace_documents(docs([1]), chunks, edges)
    assert len(before & set(store.manifest["tables"]["documents"]["parts"].values())) == 1  # one bucket alone is written anew
    monkeypatch.setattr(catalog, "BUCKET_BYTES", 500)
    store.replace_documents(docs([2, 99]), chunks, edges)
    monkeypatch.setattr(catalog, "BUCKET_BYTES", 1 << 40)
    table = catalog.Store.open(spark, str(tmp_path / "s"))
    assert table.manifest["tables"]["documents"]["buckets"] >= 8 and len(table.manifest["tables"]["documents"]["parts"]) > 4
    assert sorted(r.document_id for r in table.table("documents").collect()) == sorted(f"d{k}" for k in [*range(40), 99])
    kept = set(table.manifest["tables"]["documents"]["parts"].values())
    table.replace_documents(docs([5]), chunks, edges)
    assert len(kept - set(table.manifest["tables"]["documents"]["parts"].values())) == 1 and table.count("documents") == 41
