"""State of documents, workflows and reconciliation intents, as functions from rows to rows.

The same functions serve batches and the micro-batches of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.errors import InvalidDocument
from corvane.functions.text import backoff_seconds, chunk_strategy, trimmed, valid_json
from corvane.settings import MAX_CHUNK_SIZE, MAX_DOCUMENT_BYTES, ChunkSettings

OPEN, TERMINAL = ("queued", "processing"), ("completed", "failed")
LEASE_SECONDS, BATCH = 30, 10


def latest_status(updates: DataFrame, key: str = "document_id", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The state of each key after its updates (``status``) in order: ``key, status`` and the update's order columns.

    The first terminal status absorbs all that follow; before it the last one holds.
    """
    at = F.struct(*order)
    row = F.struct("status", *order)
    ended = F.col("status").isin(*TERMINAL)
    agg = updates.groupBy(key).agg(F.min_by(F.when(ended, row), F.when(ended, at)).alias("_end"), F.max_by(row, at).alias("_last"))
    return agg.select(key, F.coalesce("_end", "_last").alias("_s")).select(key, "_s.*")


def merge_status(state: DataFrame, updates: DataFrame, key: str = "document_id", order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The state after more updates. A key's order says which came first, so a batch may be applied twice."""
    return latest_status(state.select(key, "status", *order).unionByName(updates.select(key, "status", *order)), key, order)


def read_status(ids: DataFrame, state: DataFrame, staged: DataFrame) -> DataFrame:
    """``document_id, status`` of the asked ids: the known state, else ``queued`` if staged; others have no row."""
    known = ids.join(state.select("document_id", "status"), "document_id", "left")
    waiting = staged.select("document_id").distinct().withColumn("_staged", F.lit("queued"))
    rows = known.join(waiting, "document_id", "left").withColumn("status", F.coalesce("status", "_staged"))
    return rows.where("status is not null").select("document_id", "status")


def latest_staged(staged: DataFrame) -> DataFrame:
    """The row of the greatest generation of each document; several of that generation are an error."""
    top = F.max("generation").over(Window.partitionBy("document_id"))
    rows = staged.withColumn("_top", top).where("generation = _top").drop("_top")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("document_id")))


def check_staged(staged: DataFrame) -> DataFrame:
    rows = latest_staged(staged)
    twice = rows.where("_n > 1").select("document_id", "generation").first()
    if twice:
        raise InvalidDocument(f"generation {twice['generation']} of document {twice['document_id']} is staged more than once")
    return rows.drop("_n")


def next_generation(new: DataFrame, staged: DataFrame) -> DataFrame:
    """``new`` with the generation after the greatest one staged for its document, from 1."""
    top = staged.groupBy("document_id").agg(F.max("generation").alias("_g"))
    rows = new.join(top, "document_id", "left")
    return rows.withColumn("generation", F.coalesce("_g", F.lit(0)).cast("long") + 1).drop("_g")


def replaced(old: DataFrame, new: DataFrame, key: str = "document_id", also: DataFrame | None = None) -> DataFrame:
    """``old`` without the rows of the new keys, and the new rows. ``also``: further keys to remove, as a document without chunks is replaced too."""
    keys = new.select(key) if also is None else new.select(key).union(also.select(key))
    return old.join(keys.distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def frames_joined(frames: DataFrame, most: int) -> DataFrame:
    """Uploads out of frames (``upload_id, seq, document_id, data``): ``upload_id, document_id, raw_content, error``.

    The first frame names the document. Errors: ``metadata_missing``, ``document_changed`` (a later frame names another one), ``metadata_repeated``
    (a later frame names it again), ``too_large``, ``empty``.
    """
    rows = frames.groupBy("upload_id").agg(
        F.min_by("document_id", "seq").alias("document_id"), F.count("document_id").alias("_named"), F.countDistinct("document_id").alias("_ids"), F.sum(F.octet_length("data")).alias("_bytes"),
        F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("_parts"),
    )
    error = F.when(F.col("document_id").isNull(), "metadata_missing").when(F.col("_ids") > 1, "document_changed").when(F.col("_named") > 1, "metadata_repeated").when(F.col("_bytes") > most, "too_large").when(F.coalesce("_bytes", F.lit(0)) == 0, "empty")
    content = F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["data"], F.lit(b""))))
    return rows.select("upload_id", "document_id", F.when(error.isNull(), content).alias("raw_content"), error.alias("error"))


def frames_of(uploads: DataFrame, size: int) -> DataFrame:
    """Frames of at most ``size`` bytes out of ``upload_id, document_id, raw_content``, as ``frames_joined`` takes them; empty content is one empty frame."""
    n = F.greatest(F.ceil(F.octet_length("raw_content") / size), F.lit(1)).cast("int")
    rows = uploads.select("upload_id", "document_id", "raw_content", F.explode(F.sequence(F.lit(1), n)).alias("seq"))
    return rows.select("upload_id", "seq", F.when(F.col("seq") == 1, F.col("document_id")).alias("document_id"), F.expr(f"substring(raw_content, (seq - 1) * {size} + 1, {size})").alias("data"))


def validated_uploads(uploads: DataFrame, most: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """``uploads`` (``filename, n_bytes, chunk_strategy, chunk_size, chunk_overlap``) with the strategy that holds and ``error``, the first rule broken or null.

    JSON files are cut by size whatever was asked for.
    """
    name, size, overlap = F.col("filename"), F.col("chunk_size"), F.col("chunk_overlap")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    error = F.when(bad(F.length(trimmed(name)) > 0), "filename").when(bad(F.col("n_bytes") > 0), "empty").when(bad(F.col("n_bytes") <= most), "too_large")
    error = error.when(bad(F.col("chunk_strategy").isin(*ChunkSettings.STRATEGIES)), "chunk_strategy").when(bad(size.between(1, MAX_CHUNK_SIZE)), "chunk_size").when(bad((overlap >= 0) & (overlap < size)), "chunk_overlap")
    return uploads.withColumns({"chunk_strategy": chunk_strategy(name, F.col("chunk_strategy")), "error": error})


def event_stream(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), terminal: Column | None = None) -> DataFrame:
    """Events of each trace numbered from 1; what follows the first terminal event is left out."""
    w = Window.partitionBy("trace_id").orderBy(*order)
    rows = events.withColumn("ordinal", F.row_number().over(w))
    if terminal is None:
        return rows
    ended = F.coalesce(F.sum(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def checkpoints(events: DataFrame) -> DataFrame:
    """Rows of the checkpoint table: valid snapshots by trace and ordinal. Others are dropped."""
    return events.where(valid_json(F.col("context_snapshot"))).select("trace_id", F.col("ordinal").alias("sequence_ordinal"), F.concat(F.lit("post_"), F.col("node")).alias("node_name"), "context_snapshot")


def sse_frame(event: Column, payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def created_intents(state: DataFrame, intents: DataFrame, failed: DataFrame) -> DataFrame:
    """Intents after asking for ``failed`` (``document_id, reason_class, now``): one for each document that is queued.

    An intent that is there already gets the reason and is due anew.
    """
    queued = state.where("status = 'queued'").select("document_id")
    new = failed.join(queued, "document_id", "left_semi").select(
        "document_id", F.lit("failed").alias("desired_status"), "reason_class", F.lit(0).alias("retry_count"), F.col("now").alias("next_attempt_at")
    )
    return replaced(intents, new)


def due_intents(intents: DataFrame, now: Column, limit: int = BATCH) -> DataFrame:
    """The intents due, earliest first, at most ``limit``."""
    return intents.where(F.col("next_attempt_at") <= now).orderBy("next_attempt_at", "document_id").limit(limit)


def leased(intents: DataFrame, due: DataFrame, now: Column, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Intents with the due ones put off by the lease."""
    mark = due.select("document_id").withColumn("_due", F.lit(True))
    rows = intents.join(mark, "document_id", "left")
    later = now + F.make_dt_interval(secs=F.lit(seconds))
    return rows.withColumn("next_attempt_at", F.when(F.col("_due"), later).otherwise(F.col("next_attempt_at"))).select(intents.columns)


def rescheduled(due: DataFrame, now: Column) -> DataFrame:
    """Failed attempts with one more retry, put off by the doubling back-off."""
    wait = backoff_seconds(F.col("retry_count"))
    return due.withColumn("next_attempt_at", now + F.make_dt_interval(secs=wait)).withColumn("retry_count", F.col("retry_count") + 1)


def store_facts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a sound store shows of each document, in one row each.

    Chunk numbers from 0 without gaps, distinct ids, one model and one time, one width of vectors with finite components, distinct edges with both ends.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = nodes.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.countDistinct("chunk_id").alias("chunk_ids"), F.countDistinct("chunk_index").alias("_indexes"), F.min("chunk_index").alias("_low"), F.max("chunk_index").alias("_high"),
        F.countDistinct("embedding_model").alias("models"), F.countDistinct("ingested_at").alias("times"), F.countDistinct(F.size("embedding")).alias("widths"), F.max(F.coalesce(odd, F.lit(True)).cast("int")).alias("_odd"),
    )
    ids = nodes.select("document_id", F.col("chunk_id").alias("_end"))
    ends = edges.select("document_id", "edge_id", F.explode(F.array("source_node_id", "target_node_id")).alias("_end")).join(ids, ["document_id", "_end"], "left_anti")
    e = edges.groupBy("document_id").agg(F.count("*").alias("edge_count"), F.countDistinct("edge_id").alias("edge_ids"))
    stale = ends.groupBy("document_id").agg(F.count("*").alias("_stale"))
    rows = n.join(e, "document_id", "left").join(stale, "document_id", "left").na.fill(0, ["edge_count", "edge_ids", "_stale"])
    contiguous = (F.col("_low") == 0) & (F.col("_high") == F.col("chunk_count") - 1) & (F.col("_indexes") == F.col("chunk_count"))
    sound = contiguous & (F.col("chunk_ids") == F.col("chunk_count")) & (F.col("models") == 1) & (F.col("times") == 1) & (F.col("widths") == 1) & (F.col("_odd") == 0) & (F.col("edge_ids") == F.col("edge_count")) & (F.col("_stale") == 0)
    return rows.select("document_id", "chunk_count", "edge_count", contiguous.alias("contiguous"), (F.col("_odd") == 0).alias("finite"), F.col("_stale").alias("stale_ends"), sound.alias("sound"))


def disagreeing(counts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Documents whose chunk counts (``document_id, chunk_count``) differ between stores, with each store's count."""
    rows = None
    for name, df in counts:
        part = df.select("document_id", F.col("chunk_count").alias(name))
        rows = part if rows is None else rows.join(part, "document_id", "full_outer")
    names = [name for name, _ in counts]
    same = F.lit(True)
    for name in names[1:]:
        same = same & F.col(names[0]).eqNullSafe(F.col(name))
    return rows.where(~same).select("document_id", *names)
