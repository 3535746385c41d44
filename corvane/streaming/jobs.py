"""Structured Streaming jobs around the batch operators.

Every job reads what is there, with a checkpoint, and stops (``availableNow``); run again it takes
up what is new. Micro-batches are applied by key and order, so one that is repeated after a failure changes nothing.
"""

from __future__ import annotations

import logging
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import state
from corvane.plans import workflow
from corvane.settings import MAX_DOCUMENT_BYTES
from corvane.sources.shared import shared_dir, stored
from corvane.streaming import stateful

#: Files of one micro-batch: the bound on what is admitted at a time.
FILES_PER_BATCH = 100


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{sf_dir}/events.parquet*")


def as_updates(events: DataFrame) -> DataFrame:
    """Events as status updates of documents."""
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    return events.select((F.col("event_id") % 700).alias("document_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), status.alias("status"))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status state machine over the event stream."""
    changes = stateful.run_to_end(spark, stateful.status_changes(as_updates(event_source(spark, sf_dir))), work_dir(spark))
    return stateful.latest_change(changes)


def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user numbered up to the first purchase, as a stream."""
    events = event_source(spark, sf_dir).withColumn("trace_id", F.col("user_id"))
    return stateful.run_to_end(spark, stateful.numbered_events(events, "purchase"), work_dir(spark))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows; events later than the watermark are dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: events with less than the gap between them."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def run_windows(spark: SparkSession, sf_dir: str, root: str | None = None) -> DataFrame:
    """Windows of the event stream. Each micro-batch writes the windows that it changed, and the last value of each holds; a repeated micro-batch writes the same folder anew."""
    root = root or work_dir(spark)
    events = event_source(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))

    def changed(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/windows/epoch={epoch}")

    query = windowed(events).writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/windows").groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "epoch").alias("w"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "w.n", "w.total")


def relative_path(path, folder: str):
    """A file's path below the folder, so that files of one name in different folders are different documents; else its name."""
    top = folder.rstrip("/") + "/"
    at = F.instr(path, top)
    return F.when(at > 0, F.substring(path, at + len(top), F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))


def ingest_folder(spark: SparkSession, folder: str, store, chunk_size: int = 500, chunk_overlap: int = 50, strategy: str = "structure_aware", **models) -> DataFrame:
    """Ingest new files of a folder and below it into a ``sources.catalog.Store``, by their path below the folder.

    Returns the statuses (``document_id, status, message``) of the files of this call, one row each. A file over the size limit has failed. Each micro-batch is staged and then ingested
    by the workflow, graph included; what an earlier call left staged comes first. A repeated micro-batch gives the same store.
    """
    statuses: list[DataFrame] = []

    def batch(rows: DataFrame, epoch: int) -> None:
        name = relative_path(F.col("path"), folder)
        large = rows.where(F.col("length") > MAX_DOCUMENT_BYTES).select(name.alias("document_id"), F.lit("failed").alias("status"), F.lit(f"more than {MAX_DOCUMENT_BYTES} bytes").alias("message"))
        new = rows.where(F.col("length") <= MAX_DOCUMENT_BYTES).select(
            name.alias("document_id"), name.alias("filename"), F.col("content").alias("raw_content"), F.lit(strategy).alias("chunk_strategy"), F.lit(chunk_size).alias("chunk_size"), F.lit(chunk_overlap).alias("chunk_overlap"),
        )
        statuses.append(stored(large, "large"))
        store.stage(new)
        if (done := workflow.replay(store, **models)) is not None:
            statuses.append(done)

    if (left := workflow.replay(store, **models)) is not None:
        statuses.append(left)
    files = "path string, modificationTime timestamp, length long, content binary"
    source = spark.readStream.format("binaryFile").schema(files).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", FILES_PER_BATCH).load(folder)
    query = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.root}/_ingest").trigger(availableNow=True).start()
    query.awaitTermination()
    none = spark.createDataFrame([], "document_id string, status string, message string")
    return reduce(DataFrame.unionByName, statuses, none)


def reconcile_tick(intents: DataFrame, now, attempt: Callable[[DataFrame], DataFrame], limit: int = state.BATCH) -> DataFrame:
    """The intents after one tick: those due are leased and tried; what ``attempt`` gives back (``document_id``) is done, and the rest is put off.

    The lease is stored before anything is tried, so an attempt that never comes back is tried again when the lease is over.
    """
    due = stored(state.due_intents(intents, now, limit), "due")
    held = stored(state.leased(intents, due, now), "leased")
    done = stored(attempt(due).select("document_id").distinct(), "done")
    later = state.rescheduled(due.join(done, "document_id", "left_anti"), now)
    return stored(state.replaced(held.join(done, "document_id", "left_anti"), later), "intents")


def reconcile(
    intents: DataFrame, clock: Callable[[], Column], attempt: Callable[[DataFrame], DataFrame], ticks: int, wait: Callable[[], None] = lambda: time.sleep(1), failed: Callable[[int, Exception], None] | None = None
) -> DataFrame:
    """So many ticks with a wait between them; a tick that fails leaves the intents as they were and is told to ``failed`` (number from 0, error), or logged."""
    for k in range(ticks):
        try:
            intents = reconcile_tick(intents, clock(), attempt)
        except Exception as error:  # the next tick finds the same intents due
            if failed:
                failed(k, error)
            else:
                logging.getLogger(__name__).exception("tick %d failed", k)
        if k + 1 < ticks:
            wait()
    return intents


def compensate(write: Callable[[], None], status: Callable[[], str | None], attempts: int = 5, wait: Callable[[int], None] = lambda k: time.sleep(2**k)) -> str | None:
    """Try to write a terminal status; another writer's terminal status is as good. Returns the status that holds, or None after the last attempt."""
    for k in range(attempts):
        try:
            write()
        except Exception:  # noqa: S110  what counts is the status read below
            pass
        found = status()
        if found in state.TERMINAL:
            return found
        if k + 1 < attempts:
            wait(k)
    return None


class Dispatcher:
    """Writes checkpoints in the order in which they come, a bounded number waiting: as many in work as ``running`` and ``overflow``, then ``pending``; what comes beyond is dropped and counted.

    A write is tried ``attempts`` times and then dropped and counted, too. One thread writes, so a trace's rows never overtake each other.
    """

    def __init__(self, sink, running: int = 1, overflow: int = 4, pending: int = 16, attempts: int = 3):
        self.sink, self.admitted, self.pending, self.attempts = sink, running + overflow, pending, attempts
        self.dropped, self._waiting, self._closed = 0, deque(), False
        self._changed = threading.Condition()
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def submit(self, rows) -> str:
        with self._changed:
            n = len(self._waiting)
            if self._closed or n >= self.admitted + self.pending:
                self.dropped += 1
                return "dropped"
            self._waiting.append(rows)
            self._changed.notify_all()
            return "admitted" if n < self.admitted else "pending"

    def _work(self) -> None:
        while True:
            with self._changed:
                self._changed.wait_for(lambda: self._waiting or self._closed)
                if not self._waiting:
                    return
                rows = self._waiting[0]
            for k in range(self.attempts):
                try:
                    self.sink.write(rows)
                    break
                except Exception:
                    if k + 1 == self.attempts:
                        self.dropped += 1
            with self._changed:
                self._waiting.popleft()
                self._changed.notify_all()

    def close(self, seconds: float) -> bool:
        """Take nothing more and wait for what is there; false if it took too long."""
        with self._changed:
            self._closed = True
            self._changed.notify_all()
        self._thread.join(seconds)
        return not self._thread.is_alive()
