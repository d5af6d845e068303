"""File sinks: catalogue and account exports, finished job files, line-delimited JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varuvakt.functions.text import csv_line
from varuvakt.operators.uploads import OUTPUT_SUFFIX
from varuvakt.sources.file_sinks import CsvFile, JobFiles

# The fields of the exports, in their order.
PRODUCT_FIELDS = (
    "id", "url", "title", "current_price", "category", "has_description", "first_seen", "last_updated",
)
ACCOUNT_FIELDS = ("id", "email", "role", "created_at", "jobs", "watches", "bistand", "suggestions")


def export_products(products: DataFrame) -> DataFrame:
    """Catalogue rows for export, by id: a description is only flagged, never carried."""
    return products.select(
        "id", "url", "title", "current_price", "category",
        F.col("description").isNotNull().cast("int").alias("has_description"),
        "first_seen", "last_updated",
    ).orderBy("id")


def csv_lines(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each row as one CSV line (column ``value``), in the row order of the input."""
    return rows.select(csv_line([F.col(f) for f in fields]).alias("value"))


def write_csv(rows: DataFrame, fields: tuple[str, ...], location: str) -> None:
    """One CSV file ``location`` in the row order of the input, under one header; every line ends with CRLF."""
    rows.sparkSession.dataSource.register(CsvFile)
    csv_lines(rows, fields).write.format("csv_file").mode("append").option("header", ",".join(fields)).save(location)


def write_json(rows: DataFrame, location: str) -> None:
    rows.write.option("ignoreNullFields", "false").json(location)


def write_job_files(lines: DataFrame, location: str) -> None:
    """Write ``<location>/<job_id>_med_beskrivning.csv`` for each job of (job_id, line_no, line): CRLF between lines, none at the end.

    Lines are sorted outside memory and streamed; a job is written by one task, jobs spread over tasks. A file that is
    there already is replaced by one with the same name.
    """
    lines.sparkSession.dataSource.register(JobFiles)
    ordered = lines.repartition("job_id").sortWithinPartitions("job_id", "line_no").select("job_id", "line")
    ordered.write.format("job_files").mode("append").option("suffix", OUTPUT_SUFFIX).save(location)


def to_ndjson(rows: DataFrame) -> DataFrame:
    """Rows as one JSON object per line, absent values included as null."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def from_ndjson(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def read_ndjson(spark: SparkSession, location: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(location)
