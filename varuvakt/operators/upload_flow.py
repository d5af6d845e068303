"""An upload from its stored file to its finished file.

A round takes the tables of all uploads as they stand and does what can be done now: files of
waiting jobs become rows, rows without a result are described by the prompts of their
job, complete jobs are done. What a spent quota left open is taken up by the next
round. Calls of the generator and parsed files are stored once, so nothing that is derived from
them asks or parses again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.prompts import system_prompt, user_message
from varuvakt.operators.describe import Generate, describe_with, extract_with
from varuvakt.operators.uploads import (
    ROW_KEY,
    apply_extraction,
    job_completion,
    job_output_lines,
    merge_row_results,
    pending_rows,
)
from varuvakt.session import written
from varuvakt.sources.files import ROW_FIELDS, csv_rows, suffix_of, text_docs, xlsx_rows

#: Outcomes of a file besides those of its reader and of ``extract_with``.
MISSING, UNSUPPORTED = "missing", "unsupported"
READABLE = (".csv", ".xlsx", ".txt", ".docx")


class Uploads(NamedTuple):
    """jobs (with ``path``), headers (job_id, fieldnames), rows (job_id, row_index, cells), results (job_id, row_index, beskrivning, varfor)."""

    jobs: DataFrame
    headers: DataFrame
    rows: DataFrame
    results: DataFrame


class Extraction(NamedTuple):
    """headers and rows of extracted jobs; outcomes (job_id, outcome, rows, message, resume_at) of all."""

    headers: DataFrame
    rows: DataFrame
    outcomes: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def extract_uploads(files: DataFrame, waiting: DataFrame, generate: Generate, concurrency: int | None = None) -> Extraction:
    """Rows of the files of waiting jobs (job_id, path).

    Tables are parsed; texts are handed to the generator, which finds their products. A job whose file is not among ``files`` is
    ``missing``, one of a kind that no reader knows ``unsupported``. Only files that a job waits for are read.
    """
    wanted = files.join(waiting.select("path"), "path", "left_semi")
    tables = [reader(wanted) for reader in (csv_rows, xlsx_rows)]
    texts = written(text_docs(wanted), "upload-texts")
    asked = extract_with(texts.where("error IS NULL"), generate, ["path"], concurrency=concurrency)
    found = written(asked, "upload-products").withColumn("cells", F.array(*[F.col(f"`{f}`") for f in ROW_FIELDS]))
    products = found.where("error IS NULL")

    heads = [h.select("path", "fieldnames", "error", F.lit(None).cast("long").alias("resume_at")) for h, _ in tables]
    fields = F.array(*map(F.lit, ROW_FIELDS))
    heads.append(products.where("row_index = 0").select("path", fields.alias("fieldnames"), "error", "resume_at"))
    heads += [t.select("path", F.lit(None).cast("array<string>").alias("fieldnames"), "error", r.alias("resume_at"))
              for t, r in ((found.where("error IS NOT NULL"), F.col("resume_at")), (texts.where("error IS NOT NULL"), F.lit(None).cast("long")))]
    bodies = [r.select("path", "row_index", "cells") for r in (*[r for _, r in tables], products)]

    read = written(waiting.join(_union(heads), "path", "left"), "upload-headers")
    rows = written(waiting.join(_union(bodies), "path").select(*ROW_KEY, "cells"), "upload-rows")
    counts = rows.groupBy("job_id").agg(F.count("*").alias("rows"))
    known = suffix_of(F.col("path")).isin(*READABLE)
    none_read = F.col("fieldnames").isNull() & F.col("error").isNull()
    error = F.when(none_read, F.when(known, MISSING).otherwise(UNSUPPORTED)).otherwise(F.col("error"))
    outcomes = read.join(counts, "job_id", "left").select(
        "job_id",
        F.coalesce(error, F.lit("extracted")).alias("outcome"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        error.alias("message"),
        "resume_at",
    )
    return Extraction(read.where("fieldnames IS NOT NULL AND error IS NULL").select("job_id", "fieldnames"), rows, outcomes)


def row_prompts(rows: DataFrame, headers: DataFrame, jobs: DataFrame) -> DataFrame:
    """``rows`` (job_id, row_index) with the prompts for their texts: instructions by the options of their job, the product by its fields."""

    def field(name: str) -> Column:
        return F.get("cells", F.array_position("fieldnames", name).cast("int") - 1)

    options = jobs.select(F.col("id").alias("job_id"), "options", "custom_direction")
    instructions = system_prompt(F.col("options.tone"), F.col("options.length"), F.col("options.audience"), F.col("custom_direction"))
    site, product, price = (field(name) for name in ROW_FIELDS[:3])
    return rows.join(headers, "job_id").join(options, "job_id").select(
        *ROW_KEY, instructions.alias("system_prompt"), user_message(site, product, price).alias("user_message")
    )


def upload_round(
    state: Uploads, files: DataFrame, generate: Generate, now_ms: int, concurrency: int | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = written,
) -> tuple[Uploads, DataFrame]:
    """The tables after one round, and the rows left open (job_id, row_index, resume_at) by a spent quota.

    Jobs that wait for their rows are extracted (queued ones, and paused ones again); every row without a result
    is described; a failed row gets an empty result. A job that is done stays as it is.
    """
    waiting = state.jobs.where(F.col("status").isin("queued", "paused")).select(F.col("id").alias("job_id"), "path")
    waiting = keep(waiting.join(state.headers, "job_id", "left_anti"), "upload-waiting")
    new = extract_uploads(files, waiting, generate, concurrency)
    jobs = keep(apply_extraction(state.jobs, new.outcomes, now_ms), "upload-jobs")
    headers = keep(state.headers.unionByName(new.headers), "upload-headers")
    rows = keep(state.rows.unionByName(new.rows), "upload-rows")

    prompts = row_prompts(pending_rows(rows, state.results), headers, jobs)
    described = keep(describe_with(prompts, generate, ROW_KEY, concurrency), "upload-described")
    answered = described.where("status <> 'deferred'").select(*ROW_KEY, F.lit(0).cast("long").alias("ord"), "beskrivning", "varfor")
    results = keep(merge_row_results(state.results, answered), "upload-results")
    done = keep(job_completion(jobs, headers, rows, results, now_ms), "upload-jobs")
    return Uploads(done, headers, rows, results), described.where("status = 'deferred'").select(*ROW_KEY, "resume_at")


def output_lines(state: Uploads) -> DataFrame:
    """Lines of the finished files of done jobs, for ``write_job_files``."""
    done = state.jobs.where("status = 'done'").select(F.col("id").alias("job_id"))
    return job_output_lines(state.headers.join(done, "job_id", "left_semi"), state.rows.join(done, "job_id", "left_semi"), state.results)
