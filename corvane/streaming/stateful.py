"""State of documents and traces that lives in the stream's state store and so survives a restart.

Each key has a few values in the store. Rows of a micro-batch are taken in order, and what a row changes comes out as a numbered row, so
the numbers run on over micro-batches and restarts. Changes are appended to Parquet files; a file sink takes a repeated micro-batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.state import TERMINAL

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark: SparkSession):
    """Queries that are started within keep their state in RocksDB, which such processors need; the setting is read when a query starts."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class StatusChanges(StatefulProcessor):
    """The status of each document: the first terminal update by order holds for good, before it the last one.

    Updates may come in any order and more than once; the state after them is the one of a single fold over all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("status", "end_status string, end_at long, end_seq long, last_status string, last_at long, last_seq long, version long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.kept.get() if self.kept.exists() else None
        ended = (held[0], held[1], held[2]) if held and held[0] is not None else None
        last = (held[3], held[4], held[5]) if held else None
        version = held[6] if held else 0
        before = ended or last
        for r in rows:
            own, order = (r["status"], r["at"], r["seq"]), (r["at"], r["seq"])
            if r["status"] in TERMINAL and (ended is None or order < ended[1:]):
                ended = own
            if last is None or order > last[1:]:
                last = own
        now = ended or last
        if now != before:
            version += 1
            yield Row(document_id=key[0], version=version, status=now[0], at=now[1], seq=now[2])
        self.kept.update((*(ended or (None, None, None)), *last, version))

    def close(self) -> None:
        pass


#: ``at`` in microseconds, as times come back from the store in another form than they come in.
CHANGES = "document_id long, version long, status string, at long, seq long"


def status_changes(updates: DataFrame) -> DataFrame:
    """Of a stream of ``document_id, at, seq, status``: a row with the next ``version`` for each micro-batch that changes a document's status."""
    rows = updates.select(F.col("document_id").cast("long"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("seq").cast("long"), "status")
    return rows.groupBy("document_id").transformWithState(StatusChanges(), CHANGES, "Append", "None")


def latest_change(changes: DataFrame) -> DataFrame:
    """The status of each document out of all its changes."""
    rows = changes.groupBy("document_id").agg(F.max_by(F.struct("status", "at", "seq"), "version").alias("s"))
    return rows.select("document_id", "s.status", F.timestamp_micros("s.at").cast("timestamp_ntz").alias("at"), "s.seq")


class EventNumbers(StatefulProcessor):
    """Events of each trace numbered from 1 over all micro-batches; the first terminal one ends its trace, and what follows is left out."""

    def __init__(self, terminal: str):
        self.terminal = terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("ordinal", "ordinal long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ordinal, ended = tuple(self.kept.get()) if self.kept.exists() else (0, False)
        for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])) if not ended else ():
            ordinal += 1
            yield Row(trace_id=key[0], ts=r["ts"], event_id=r["event_id"], event_type=r["event_type"], ordinal=ordinal)
            if r["event_type"] == self.terminal:
                ended = True
                break
        self.kept.update((ordinal, ended))

    def close(self) -> None:
        pass


NUMBERED = "trace_id long, ts timestamp, event_id long, event_type string, ordinal long"


def numbered_events(events: DataFrame, terminal: str) -> DataFrame:
    """Of a stream of ``trace_id, ts, event_id, event_type``: its events with their ``ordinal``.

    Within a micro-batch the order is by time and id; a later micro-batch's events come after it.
    """
    rows = events.select(F.col("trace_id").cast("long"), F.col("ts").cast("timestamp"), F.col("event_id").cast("long"), "event_type")
    return rows.groupBy("trace_id").transformWithState(EventNumbers(terminal), NUMBERED, "Append", "None")


def run_to_end(spark: SparkSession, rows: DataFrame, root: str) -> DataFrame:
    """Append what a stream gives to ``root`` until all input is read; run again with the same root it goes on from there. Returns all rows so far."""
    with rocks_store(spark):
        query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")
