"""Generated texts for uploaded rows as a stream into the result table, finishing jobs on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from varuvakt.operators.uploads import ROW_KEY, job_completion, merge_row_results
from varuvakt.schemas import TABLES
from varuvakt.sources.snapshots import BUCKETS, SnapshotStore
from varuvakt.streaming.clock import Clock, read_clock
from varuvakt.streaming.intake import COMPACT_AFTER, REJECT_SCHEMA, json_lines, query_id, split_rejects

RESULT_SCHEMA = "job_id long, row_index long, beskrivning string, varfor string"
MESSAGE_SCHEMA = "job_id long, row_index long, ord long, beskrivning string, varfor string"


def open_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> SnapshotStore:
    """``buckets``: folders of each laid-out base; choose them so that one holds a few files of a task's size."""
    schemas = {"jobs": TABLES["jobs"], "results": RESULT_SCHEMA, "rejects": REJECT_SCHEMA}
    return SnapshotStore(spark, root, schemas, {"jobs": ["id"], "results": ROW_KEY, "rejects": None}, {"jobs": "id", "results": "job_id"}, buckets)


def apply_row_results(
    store: SnapshotStore, headers: DataFrame, rows: DataFrame, messages: DataFrame, batch: int, now_ms: Clock, writer: str = ""
) -> bool:
    """Commit one batch of row results, its unreadable lines and the jobs it completes.

    Only jobs named in the batch are looked at; a job that is done stays as it is.
    """
    if store.is_committed(batch, writer):
        return False
    held = messages.persist()
    try:
        readable, rejects = split_rejects(held)
        return store.commit(batch, _changes(store, headers, rows, readable, read_clock(now_ms)) | rejects, writer)
    finally:
        held.unpersist()


def _changes(store: SnapshotStore, headers: DataFrame, rows: DataFrame, messages: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    named = messages.select("job_id").distinct()
    jobs, results = store.lookup("jobs", named.withColumnRenamed("job_id", "id")), store.lookup("results", named)
    keys = messages.select(*ROW_KEY).distinct()
    merged = store.stage("results", merge_row_results(results.join(keys, ROW_KEY, "left_semi"), messages))

    def mine(df: DataFrame) -> DataFrame:
        return df.join(named, "job_id", "left_semi")

    standing = mine(results).join(keys, ROW_KEY, "left_anti").unionByName(merged)
    touched = jobs.join(named.withColumnRenamed("job_id", "id"), "id", "left_semi")
    return {"jobs": job_completion(touched, mine(headers), mine(rows), standing, now_ms)}


def stream_row_results(
    spark: SparkSession,
    source: str,
    store: SnapshotStore,
    headers: DataFrame,
    rows: DataFrame,
    checkpoint: str,
    now_ms: Clock,
    files_per_batch: int = 1,
    compact_after: int = COMPACT_AFTER,
    within: str | None = None,
) -> StreamingQuery:
    """Consume JSON files of row results from ``source`` until none is left.

    ``now_ms`` is a time or a function that is asked once per batch. Lines that do not fit the schema go to the table ``rejects``.
    With ``within`` (a time such as "2 days") messages that are delivered again count once.
    """
    writer = query_id(spark, checkpoint)

    def work(batch: DataFrame, number: int) -> None:
        apply_row_results(store, headers, rows, batch, number, now_ms, writer())
        store.compact(compact_after)

    return (
        json_lines(spark, source, MESSAGE_SCHEMA, files_per_batch, within)
        .writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
