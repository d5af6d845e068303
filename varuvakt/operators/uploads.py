"""Upload jobs: rows to describe, results, completion and the finished file.

Rows are ``(job_id, row_index, cells array)``, aligned with the job's header
``(job_id, fieldnames array)``; a job without header has not been extracted yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varuvakt.functions.text import csv_cell
from varuvakt.operators.merge import prefixed, update_existing, upsert, with_new_ids

ROW_KEY = ["job_id", "row_index"]
JOBS_PER_ACCOUNT = 200
# Columns added to the finished file, and the file's name.
RESULT_FIELDS = ("Beskrivning", "Varför")
OUTPUT_SUFFIX = "_med_beskrivning.csv"


def job_list(jobs: DataFrame, limit: int = JOBS_PER_ACCOUNT) -> DataFrame:
    """The newest jobs of every account with their progress; row contents stay hidden."""
    newest = Window.partitionBy("account_id").orderBy(F.desc("created_at"), F.desc("id"))
    progress = F.concat_ws("/", F.col("succeeded").cast("string"), F.col("total").cast("string"))
    return (
        jobs.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
        .select(
            "account_id", F.col("rank").cast("long").alias("rank"), "id", "status", "filename",
            progress.alias("progress"), "created_at",
        )
    )


def queue_uploads(jobs: DataFrame, uploads: DataFrame, now_ms: int) -> DataFrame:
    """New queued jobs for accepted files (account_id, path, filename, options, custom_direction).

    Where ``jobs`` has a column ``path``, a job carries the place of its file.
    """
    stamp = F.lit(now_ms).cast("long")
    given = {c: F.col(c) for c in ("account_id", "filename", "options", "custom_direction")}
    set_values = {"status": F.lit("queued"), "total": F.lit(0), "succeeded": F.lit(0), "created_at": stamp, "updated_at": stamp}
    values = given | set_values
    fresh = uploads.select(
        "path",
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in jobs.schema
            if f.name not in ("id", "path")
        ],
    )
    return with_new_ids(fresh, jobs, "id", ["path"]).select(*jobs.columns)


def apply_extraction(jobs: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """Job table after extraction outcomes (job_id, outcome, rows, message).

    ``extracted`` moves a job on to processing with its row count, ``deferred``
    (quota ended) pauses it, anything else is an error with its message. A job
    that has been extracted before keeps its state.
    """
    changes = prefixed(outcomes.withColumnRenamed("job_id", "id"), ["id"])
    waiting = F.col("status").isin("queued", "paused")
    outcome = F.col("new_outcome")
    status = F.when(outcome == "extracted", "processing").when(outcome == "deferred", "paused").otherwise("error")
    values = {
        "status": status,
        "total": F.when(outcome == "extracted", F.col("new_rows")).otherwise(F.col("total")),
        "error_message": F.when(status == "error", F.col("new_message")).otherwise(F.col("error_message")),
        "updated_at": F.lit(now_ms),
    }
    return update_existing(
        jobs, changes, ["id"], {c: F.when(waiting, v).otherwise(F.col(c)) for c, v in values.items()}
    )


def pending_rows(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows without a result yet."""
    return rows.join(results.select(*ROW_KEY), ROW_KEY, "left_anti")


def merge_row_results(results: DataFrame, incoming: DataFrame) -> DataFrame:
    """Results after a batch (job_id, row_index, ord, beskrivning, varfor); the last write of a row wins.

    A failed row arrives with NULL texts and is stored as an empty result.
    """
    fields = ["beskrivning", "varfor"]
    last = F.max_by(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in fields]), F.col("ord"))
    folded = incoming.groupBy(*ROW_KEY).agg(last.alias("_r")).select(*ROW_KEY, "_r.*")
    return upsert(
        results,
        folded,
        ROW_KEY,
        {c: F.col(f"new_{c}") for c in fields},
        {c: F.col(c) for c in fields},
    )


def job_progress(headers: DataFrame, rows: DataFrame, results: DataFrame) -> DataFrame:
    """Row, result and success counts of every extracted job.

    A job is complete when it has at least as many results as rows, so an
    extracted file without rows is complete at once.
    """
    tagged_rows = rows.select(*ROW_KEY, F.lit(1).alias("is_row"), F.lit(0).alias("is_result"), F.lit(0).alias("filled"))
    tagged_results = results.select(
        *ROW_KEY,
        F.lit(0).alias("is_row"),
        F.lit(1).alias("is_result"),
        F.when(F.coalesce("beskrivning", F.lit("")) != "", 1).otherwise(0).alias("filled"),
    )
    per_row = tagged_rows.unionByName(tagged_results).groupBy(*ROW_KEY).agg(
        *[F.max(c).alias(c) for c in ("is_row", "is_result", "filled")]
    )
    per_job = per_row.groupBy("job_id").agg(
        F.sum("is_row").alias("rows"),
        F.sum("is_result").alias("results"),
        F.sum(F.col("is_row") * F.col("filled")).alias("succeeded"),
    )
    counts = ("rows", "results", "succeeded")
    filled = headers.select("job_id").join(per_job, "job_id", "left").select(
        "job_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts]
    )
    return filled.withColumn("complete", F.col("results") >= F.col("rows"))


def job_completion(
    jobs: DataFrame, headers: DataFrame, rows: DataFrame, results: DataFrame, now_ms: int
) -> DataFrame:
    """Job table with complete jobs set to done; a job that is done already is left alone."""
    complete = job_progress(headers, rows, results).filter("complete").select("job_id", "succeeded")
    changes = prefixed(complete.withColumnRenamed("job_id", "id"), ["id"])
    open_job = F.col("status") != "done"

    def once(value: Column, col: str) -> Column:
        return F.when(open_job, value).otherwise(F.col(col))

    key = F.concat(F.col("account_id").cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(OUTPUT_SUFFIX))
    values = {
        "status": F.lit("done"),
        "succeeded": F.col("new_succeeded"),
        "output_key": key,
        "updated_at": F.lit(now_ms),
    }
    return update_existing(
        jobs, changes, ["id"], {c: once(v, c) for c, v in values.items() if c in jobs.columns}
    )


def job_output_lines(headers: DataFrame, rows: DataFrame, results: DataFrame) -> DataFrame:
    """Lines of the finished files of complete jobs: (job_id, line_no, line); line 0 is the header.

    Each line is the input columns in file order plus the two result columns.
    """
    complete = job_progress(headers, rows, results).filter("complete").select("job_id")
    done_headers = headers.join(complete, "job_id", "left_semi")
    fields = F.concat("fieldnames", F.array(*[F.lit(f) for f in RESULT_FIELDS]))
    head = done_headers.select(
        "job_id", F.lit(0).cast("long").alias("line_no"), _csv_join(fields).alias("line")
    )
    texts = results.select(*ROW_KEY, "beskrivning", "varfor")
    empty = F.lit("")
    cells = F.concat("cells", F.array(F.coalesce("beskrivning", empty), F.coalesce("varfor", empty)))
    body = (
        rows.join(complete, "job_id", "left_semi")
        .join(texts, ROW_KEY, "left")
        .select("job_id", (F.col("row_index") + 1).cast("long").alias("line_no"), _csv_join(cells).alias("line"))
    )
    return head.unionByName(body)


def _csv_join(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_cell), ",")


def ready_worklist(worklist: DataFrame, now_ms: int) -> DataFrame:
    """Entries that are not paused, or whose pause is over.

    A paused entry carries ``resume_at``; it is retried then, but at the
    earliest one second after it was put back (``deferred_at``).
    """
    not_before = F.when(
        F.col("resume_at").isNotNull(), F.greatest(F.col("resume_at"), F.col("deferred_at") + F.lit(1000))
    )
    return worklist.withColumn("not_before", not_before).filter(
        F.col("not_before").isNull() | (F.col("not_before") <= F.lit(now_ms))
    )
