"""Incremental ingest: batch helpers and Structured Streaming.

A chunk stream is deduplicated within its watermark and written by ``foreachBatch``; each
batch upserts, so a replayed batch leaves the same table.  Sessions end after a time
without activity; the batch form and the streaming form agree on what they emit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.maintenance import latest
from ..operators.prefix import by_segment, sums_before
from ..runtime import complete_versions

#: Phases of a run in order; INIT before the first, ERROR after a failure (fixed values).
PHASES = ("INIT", "DOCUMENT_DISCOVERY", "DOCUMENT_PROCESSING", "GRAPH_AUGMENTATION", "EMBEDDING_GENERATION", "HNSW_INDEXING", "SEARCH_SYSTEM_UPDATE", "FINISHED", "ERROR")


def sessions(events: DataFrame, user: str, ts: str, tie: str, hours: int = 24) -> DataFrame:
    """``user, session_start, last_seen, n_events``: a gap of more than ``hours`` ends a session. Null users form their own.

    Times are looked at week by week, and weeks meet by their first and last event, so a
    user (or the missing one) with very many events is not gathered in one task.
    """
    e = events.where(F.col(ts).isNotNull()).select(user, ts, tie).withColumn("_week", F.floor(F.col(ts).cast("timestamp").cast("long") / (7 * 86_400)))
    weeks = e.groupBy(user, "_week").agg(F.max(ts).alias("_last"))
    weeks = weeks.select(user, "_week", F.lag("_last").over(W.partitionBy(user).orderBy("_week")).alias("_before"))
    inside = W.partitionBy(user, "_week").orderBy(ts, tie)
    e = by_segment(e.withColumn("_prev", F.lag(ts).over(inside)), weeks, [user, "_week"])
    gap = F.coalesce("_prev", "_before")
    marked = e.withColumn("_new", F.when(gap.isNull() | (F.col(ts) > gap + F.expr(f"INTERVAL {hours} HOURS")), 1).otherwise(0)).drop("_prev", "_before")
    k = sums_before(marked, [user], "_week", [ts, tie], {"_k": F.col("_new")}).withColumn("_k", F.col("_k") + F.col("_new"))
    return k.groupBy(user, "_k").agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_seen"), F.count("*").alias("n_events")).drop("_k")


def stream_sessions(events: DataFrame, user: str, ts: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """The streaming form on event time with a watermark; wants a timestamp, so zone-less times are cast."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(user, F.session_window(ts, f"{hours} hours").alias("w")).agg(F.max(ts).alias("last_seen"), F.count("*").alias("n_events"))
    return g.select(user, F.col("w.start").alias("session_start"), "last_seen", "n_events")


def expired(rows: DataFrame, ts: str, now: str | None = None, hours: int = 24) -> DataFrame:
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return rows.where(F.col(ts).cast("timestamp") < at - F.expr(f"INTERVAL {hours} HOURS"))


def chunk_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 2) -> DataFrame:
    """JSON-lines chunks as they arrive, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def upsert_table(spark: SparkSession, batch: DataFrame, path: str, keys: list[str], order: list[str], batch_id: int) -> None:
    """Write a new version of the table at ``path`` with the batch merged in; a batch seen before changes nothing.

    The version is named after the batch, and readers take the last complete one.
    """
    name = f"v{batch_id:012d}"
    done = complete_versions(spark, path)
    if name in done:
        return
    rows = batch if not done else spark.read.parquet(f"{path}/{done[-1]}").unionByName(batch, allowMissingColumns=True)
    latest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    done = complete_versions(spark, path)
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write ``df`` as the next version of the table; readers take the last complete one."""
    done = complete_versions(spark, path)
    n = int(done[-1][1:]) + 1 if done else 0
    df.write.mode("overwrite").parquet(f"{path}/v{n:012d}")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True) -> StreamingQuery:
    """Start the writer; with ``once`` it takes what is there and ends."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        upsert_table(batch.sparkSession, rows, path, keys, order, batch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def deduplicate(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def document_states(stream: DataFrame, key: str = "path") -> DataFrame:
    """``path, status, attempts`` by a custom stateful operator over ``path, event``: start, complete or fail.

    A document is ``processing`` from its start until its end is seen; an end without a
    start counts; attempts are starts.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        status, attempts = state.get if state.exists else ("new", 0)
        for f in frames:
            for e in f["event"]:
                if e == "start":
                    status, attempts = "processing", attempts + 1
                elif e in ("complete", "fail"):
                    status = "completed" if e == "complete" else "failed"
        state.update((status, attempts))
        yield pd.DataFrame({"path": [k[0]], "status": [status], "attempts": [attempts]})

    return stream.groupBy(key).applyInPandasWithState(step, "path string, status string, attempts int", "status string, attempts int", "update", "NoTimeout")


def pipeline_state(phase: str, done: int, total: int) -> dict:
    """The row that a run stores between phases."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}")
    return {"phase": phase, "processed": done, "total": total, "resume": phase not in ("INIT", "FINISHED", "ERROR"), "percent": done / max(1, total) * 100}


def run_pipeline(phases: dict[str, Callable[[], dict]], save: Callable[[dict], None], start: str = "INIT", on_error: Callable[[str, str], None] | None = None) -> dict:
    """Run the phases in order, saving the state row after each; with ``start`` from the phase after it.

    A phase that raises ends the run with state ERROR; phases without a function are passed over.
    """
    if start not in PHASES:
        raise ValueError(f"unknown phase {start!r}")
    todo = PHASES[PHASES.index(start) + 1 : -2] if start != "ERROR" else PHASES[1:-2]
    results: dict = {}
    for k, phase in enumerate(todo):
        try:
            results[phase] = phases[phase]() if phase in phases else {"skipped": True}
        except Exception as e:
            save(pipeline_state("ERROR", k, len(todo)))
            if on_error:
                on_error(phase, str(e))
            return {"success": False, "error": str(e), "failed_phase": phase, "results": results}
        save(pipeline_state(phase, k + 1, len(todo)))
    save(pipeline_state("FINISHED", len(todo), len(todo)))
    return {"success": True, "results": results}


def can_resume(state: dict | None) -> bool:
    return bool(state and state.get("resume"))


def failed(state: DataFrame) -> DataFrame:
    return state.where(F.lower("processing_status") == "failed")


def reset_failed(state: DataFrame) -> DataFrame:
    return state.withColumn("processing_status", F.when(F.lower("processing_status") == "failed", "pending").otherwise(F.col("processing_status")))


def clear_state(state: DataFrame, keys: list[str] | None = None, key: str = "path") -> DataFrame:
    """The state without the named documents, or none at all."""
    return state.limit(0) if keys is None else state.where(~F.coalesce(F.col(key).isin(*keys), F.lit(False)))


def queue_stats(state: DataFrame) -> DataFrame:
    """One row: ``active, scheduled, total_pending, finished, failed`` of the status log (status in any case)."""
    s = F.lower(F.trim("processing_status"))
    out = state.agg(F.count_if(s == "processing").alias("active"), F.count_if(s.isin("pending", "queued")).alias("scheduled"), F.count_if(s.isin("completed", "skipped")).alias("finished"), F.count_if(s == "failed").alias("failed"))
    return out.withColumn("total_pending", F.col("active") + F.col("scheduled"))


def task_status(tasks: DataFrame, queue: DataFrame, key: str = "file_id") -> DataFrame:
    """Stored status of each task with what the queue says of it; the queue wins where it knows the task."""
    q = queue.select(key, F.lower("state").alias("queue_state"))
    return tasks.join(q, key, "left").withColumn("current_status", F.coalesce("queue_state", F.lower("processing_status")))
