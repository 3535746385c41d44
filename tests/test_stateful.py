"""Streams that keep their state over restarts."""

from pyspark.sql import functions as F

from corvane.operators import state
from corvane.streaming import jobs, stateful

UPDATES = "document_id long, at timestamp_ntz, seq long, status string"


def updates(spark, ids):
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("document_id"), F.to_timestamp_ntz(F.lit(f"2024-01-01 00:00:{at:02d}")).alias("at"), F.lit(at).cast("long").alias("seq"), F.lit(s).alias("status")) for d, at, s in ids])).alias("x")).select("x.*")


BATCHES = [
    [(1, 1, "queued"), (2, 1, "queued"), (1, 5, "completed"), (3, 9, "processing")],
    [(1, 6, "processing"), (2, 3, "processing"), (2, 2, "queued"), (4, 4, "failed")],
    [(1, 7, "failed"), (2, 8, "completed"), (3, 2, "queued"), (4, 3, "completed"), (5, 1, "queued")],
    [(2, 9, "processing"), (5, 1, "queued")],
]


def test_statuses_survive_restarts(spark, tmp_path):
    """Each call is a query of its own, with nothing but the checkpoint between them."""
    root, folder = str(tmp_path / "root"), str(tmp_path / "in")
    schema, seen = spark.createDataFrame([], UPDATES).schema, []
    for batch in BATCHES:
        updates(spark, batch).coalesce(1).write.mode("append").parquet(folder)
        seen += batch
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        changes = stateful.run_to_end(spark, stateful.status_changes(rows), root)
        got = {r.document_id: (r.status, r.seq) for r in stateful.latest_change(changes).collect()}
        assert got == {r.document_id: (r.status, r.seq) for r in state.latest_status(updates(spark, seen)).collect()}
    found = changes.groupBy("document_id").agg(F.sort_array(F.collect_list("version")).alias("v")).collect()
    assert all(r.v == list(range(1, len(r.v) + 1)) for r in found) and {r.document_id: r.v[-1] for r in found}[1] == 1
    before = changes.count()
    assert stateful.run_to_end(spark, stateful.status_changes(spark.readStream.schema(schema).parquet(folder)), root).count() == before


def test_ordinals_run_on_over_restarts(spark, tmp_path):
    schema = "trace_id long, ts timestamp_ntz, event_id long, event_type string"
    frame = lambda rows: spark.createDataFrame(rows, "trace_id long, t string, event_id long, event_type string").select("trace_id", F.to_timestamp_ntz("t").alias("ts"), "event_id", "event_type")
    at = lambda k: f"2024-01-01 00:00:{k:02d}"
    parts = [[(1, at(2), 2, "a"), (1, at(1), 1, "a"), (2, at(1), 3, "end"), (2, at(2), 4, "a")], [(1, at(3), 5, "b"), (1, at(4), 6, "end"), (1, at(5), 7, "a")], [(1, at(6), 8, "a"), (2, at(9), 9, "end"), (3, at(1), 10, "a")]]
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")
    for rows in parts:
        frame(rows).coalesce(1).write.mode("append").parquet(folder)
        out = stateful.run_to_end(spark, stateful.numbered_events(spark.readStream.schema(schema).parquet(folder), "end"), root)
    assert sorted((r.trace_id, r.ordinal, r.event_id) for r in out.collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 5), (1, 4, 6), (2, 1, 3), (3, 1, 10)]
    plain = state.event_stream(frame([r for p in parts for r in p]), terminal=F.col("event_type") == "end")
    assert sorted((r.trace_id, r.ordinal, r.event_id) for r in plain.collect()) == sorted((r.trace_id, r.ordinal, r.event_id) for r in out.collect())


def test_windows_are_kept_over_restarts(spark, data, tmp_path):
    root = str(tmp_path / "w")
    first = sorted(map(tuple, jobs.run_windows(spark, data, root).collect()))
    assert sorted(map(tuple, jobs.run_windows(spark, data, root).collect())) == first and first


def test_provider_is_put_back(spark):
    before = spark.conf.get(stateful.PROVIDER)
    with stateful.rocks_store(spark):
        assert spark.conf.get(stateful.PROVIDER) == stateful.ROCKS
    assert spark.conf.get(stateful.PROVIDER) == before
