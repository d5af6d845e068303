"""Uploaded files and upload jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.text import csv_line
from varuvakt.operators import uploads
from varuvakt.operators.uploads import OUTPUT_SUFFIX
from varuvakt.plans.fixtures import NOW_MS, Fixture
from varuvakt.plans.office import document, workbook
from varuvakt.plans.registry import query
from varuvakt.session import shared_dir
from varuvakt.sources import files
from varuvakt.sources.exports import write_job_files

ROWS_PER_FILE = 500
# Uploaded rows as cells, cut into files of at most ROWS_PER_FILE rows; one line per row, so line ends become blanks.
FILE_ROWS = """
SELECT concat('uploads/', cast(job_id AS {s}), '-', cast(row_index {div} 500 AS {s}), '{suffix}') AS path, row_index,
 'butik "1", nord' AS site, replace(product, '{nl}', ' ') AS product, row_index * 10 AS price,
 CASE WHEN row_index % 3 = 0 THEN 'https://a.example/' ELSE '' END AS link FROM upload_rows"""


def file_rows(fx: Fixture, suffix: str) -> DataFrame:
    sql = FILE_ROWS.replace("{s}", "string").replace("{div}", "div").replace("{nl}", "\\n").replace("{suffix}", suffix)
    return fx.spark.sql(sql.replace("FROM upload_rows", "FROM {rows}"), rows=fx.upload_rows)


def file_rows_sql(suffix: str) -> str:
    sql = FILE_ROWS.replace("{s}", "varchar").replace("{div}", "//").replace("'{nl}'", "chr(10)").replace("{suffix}", suffix)
    return f"""WITH cells AS ({sql})
SELECT path, row_number() OVER (PARTITION BY path ORDER BY row_index) - 1 AS row_index, site, product, price::varchar AS price, link FROM cells"""


def named_cells(rows: DataFrame) -> DataFrame:
    names = ("site", "product", "price", "link")
    return rows.select("path", "row_index", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query("csv_rows", file_rows_sql(".csv"))
def _csv_rows(fx: Fixture) -> DataFrame:
    # Rows without a link are written short, and every file gets an empty line.
    full = csv_line([F.col(c) for c in ("site", "product", "price", "link")])
    line = F.when(F.col("link") == "", csv_line([F.col(c) for c in ("site", "product", "price")])).otherwise(full)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_index", "line"))), lambda e: e["line"]), "\r\n")
    text = file_rows(fx, ".csv").withColumn("line", line).groupBy("path").agg(body.alias("body"))
    content = F.encode(F.concat(F.lit("\ufeffSite,Product,Price (SEK),Link\r\n\r\n"), "body"), "UTF-8")
    uploaded = text.select("path", content.alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return named_cells(files.csv_rows(uploaded)[1])


@query("xlsx_rows", file_rows_sql(".xlsx"))
def _xlsx_rows(fx: Fixture) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_index")
        table: list[list[object]] = [["Site", "Product", "Price (SEK)", "Link"], []]
        for site, product, price, link in zip(rows["site"], rows["product"], rows["price"], rows["link"]):
            table.append([site, product, int(price), link or None])
        data = workbook([table, [["ett annat blad"]]])
        return pd.DataFrame({"path": [rows["path"].iat[0]], "content": [data], "length": [len(data)]})

    # One group is one file of at most ROWS_PER_FILE rows.
    books = file_rows(fx, ".xlsx").groupBy("path").applyInPandas(build, "path string, content binary, length long")
    return named_cells(files.xlsx_rows(books)[1])


@query(
    "text_docs",
    """SELECT 'docs/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.docx' END AS path,
 CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) END AS text FROM documents""",
)
def _text_docs(fx: Fixture) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = [
                text.encode("utf-8") if path.endswith(".txt") else document(text.split("\n"))
                for path, text in zip(batch["path"], batch["text"])
            ]
            yield pd.DataFrame({"path": batch["path"], "length": [len(c) for c in contents], "content": contents})

    named = fx.documents.selectExpr(
        "concat('docs/', cast(doc_id AS string), CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.docx' END) AS path", "text"
    )
    return files.text_docs(named.mapInPandas(build, "path string, length long, content binary")).select("path", "text")


MANIFEST = """
SELECT concat('in.box/', cast(doc_id AS {s}), CASE doc_id % 8 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.txt' WHEN 3 THEN '.Docx'
  WHEN 4 THEN '.pdf' WHEN 5 THEN '.exe' WHEN 6 THEN '.tar.csv' ELSE 'namn' END) AS path, n_chars * 3000 AS length FROM documents"""


@query(
    "upload_manifest",
    f"""WITH listed AS (SELECT *, lower(split_part(path, '/', 2)) AS name FROM ({MANIFEST.replace('{s}', 'varchar')})),
judged AS (SELECT path, length, CASE WHEN contains(name, '.') THEN '.' || split_part(name, '.', -1) ELSE right(name, 1) END AS suffix FROM listed),
reasons AS (SELECT *, CASE WHEN suffix NOT IN ('.csv', '.docx', '.pdf', '.txt', '.xlsx') THEN 'unsupported_type'
 WHEN length > 52428800 THEN 'too_large' END AS reject_reason FROM judged)
SELECT *, CASE WHEN reject_reason IS NULL THEN 'queued' ELSE 'refused' END AS status FROM reasons""",
)
def _upload_manifest(fx: Fixture) -> DataFrame:
    sql = MANIFEST.replace("{s}", "string").replace("FROM documents", "FROM {documents}")
    return files.upload_manifest(fx.spark.sql(sql, documents=fx.documents))


@query(
    "upload_jobs",
    f"""WITH accepted AS (SELECT path, split_part(path, '/', 2) AS filename, length FROM ({MANIFEST.replace('{s}', 'varchar')})
 WHERE regexp_matches(lower(path), '\\.(csv|docx|pdf|txt|xlsx)$') AND length <= 52428800)
SELECT (SELECT max(id) FROM jobs) + row_number() OVER (ORDER BY BUCKET(path), path) AS id, length % 7 AS account_id, 'queued' AS status,
 filename, 0::bigint AS total, {{now}} AS created_at FROM accepted""",
)
def _upload_jobs(fx: Fixture) -> DataFrame:
    sql = MANIFEST.replace("{s}", "string").replace("FROM documents", "FROM {documents}")
    manifest = files.upload_manifest(fx.spark.sql(sql, documents=fx.documents))
    options = F.struct(*[F.lit("").alias(c) for c in ("tone", "length", "audience")])
    accepted = manifest.filter("status = 'queued'").select(
        (F.col("length") % 7).alias("account_id"),
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        options.alias("options"),
        F.lit("").alias("custom_direction"),
    )
    fresh = uploads.queue_uploads(fx.jobs, accepted, NOW_MS)
    return fresh.select("id", "account_id", "status", "filename", "total", "created_at")


OUTCOMES = """
SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'extracted' WHEN 1 THEN 'deferred' ELSE 'no_products' END AS outcome, count(*) AS rows,
 CASE WHEN job_id % 3 = 2 THEN concat('inga produkter i ', cast(job_id AS {s})) ELSE NULL END AS message FROM upload_rows GROUP BY job_id"""


@query(
    "apply_extraction",
    f"""WITH outcomes AS ({OUTCOMES.replace('{s}', 'varchar')}),
joined AS (SELECT j.*, o.outcome, o.rows, o.message, o.job_id IS NOT NULL AND j.status IN ('queued', 'paused') AS moved FROM jobs j LEFT JOIN outcomes o ON o.job_id = j.id)
SELECT id, CASE WHEN NOT moved THEN status WHEN outcome = 'extracted' THEN 'processing' WHEN outcome = 'deferred' THEN 'paused' ELSE 'error' END AS status,
 CASE WHEN moved AND outcome = 'extracted' THEN rows ELSE total END AS total, CASE WHEN moved THEN message END AS error_message,
 CASE WHEN moved THEN {{now}} ELSE updated_at END AS updated_at FROM joined""",
)
def _apply_extraction(fx: Fixture) -> DataFrame:
    sql = OUTCOMES.replace("{s}", "string").replace("FROM upload_rows", "FROM {rows}")
    outcomes = fx.spark.sql(sql, rows=fx.upload_rows)
    return uploads.apply_extraction(fx.jobs, outcomes, NOW_MS).select("id", "status", "total", "error_message", "updated_at")


@query(
    "job_list",
    """SELECT account_id, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, id DESC) AS rank, id, status, filename,
 succeeded || '/' || total AS progress, created_at FROM jobs QUALIFY rank <= 200""",
)
def _job_list(fx: Fixture) -> DataFrame:
    return uploads.job_list(fx.jobs)


@query(
    "pending_rows",
    """SELECT * FROM upload_rows u WHERE NOT EXISTS (SELECT 1 FROM row_results r WHERE r.job_id = u.job_id AND r.row_index = u.row_index)""",
)
def _pending_rows(fx: Fixture) -> DataFrame:
    return uploads.pending_rows(fx.upload_rows, fx.row_results)


# Late results for every row: each row twice, and one in four a failure without text.
INCOMING = """
SELECT job_id, row_index, row_index * 10 + 1 AS ord, concat('tidig ', product) AS beskrivning, 'a' AS varfor FROM upload_rows
UNION ALL SELECT job_id, row_index, row_index * 10 + 2 AS ord, CASE WHEN (job_id + row_index) % 4 = 0 THEN NULL ELSE concat('sen ', product) END AS beskrivning,
 CASE WHEN (job_id + row_index) % 4 = 0 THEN NULL ELSE 'b' END AS varfor FROM upload_rows"""


def incoming(fx: Fixture) -> DataFrame:
    return fx.spark.sql(INCOMING.replace("FROM upload_rows", "FROM {rows}"), rows=fx.upload_rows)


@query(
    "merge_row_results",
    f"""WITH incoming AS ({INCOMING}),
latest AS (SELECT DISTINCT ON (job_id, row_index) job_id, row_index, coalesce(beskrivning, '') AS beskrivning, coalesce(varfor, '') AS varfor
 FROM incoming ORDER BY job_id, row_index, ord DESC)
SELECT * FROM latest UNION ALL SELECT * FROM row_results r
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.job_id = r.job_id AND l.row_index = r.row_index)""",
)
def _merge_row_results(fx: Fixture) -> DataFrame:
    return uploads.merge_row_results(fx.row_results, incoming(fx))


COMPLETE = """progress AS (SELECT u.job_id, count(*) AS n_rows, count(r.job_id) FILTER (r.beskrivning <> '') AS succeeded,
  (SELECT count(*) FROM row_results x WHERE x.job_id = u.job_id) AS n_results
 FROM upload_rows u LEFT JOIN row_results r ON r.job_id = u.job_id AND r.row_index = u.row_index GROUP BY u.job_id),
complete AS (SELECT * FROM progress WHERE n_results >= n_rows)"""


@query(
    "job_completion",
    f"""WITH {COMPLETE}
SELECT j.id, CASE WHEN c.job_id IS NULL OR j.status = 'done' THEN j.status ELSE 'done' END AS status,
 CASE WHEN c.job_id IS NULL OR j.status = 'done' THEN j.succeeded ELSE c.succeeded END AS succeeded,
 CASE WHEN c.job_id IS NULL OR j.status = 'done' THEN j.output_key ELSE j.account_id || '/' || j.id || '_med_beskrivning.csv' END AS output_key,
 CASE WHEN c.job_id IS NULL OR j.status = 'done' THEN j.updated_at ELSE {{now}} END AS updated_at
FROM jobs j LEFT JOIN complete c ON c.job_id = j.id""",
)
def _job_completion(fx: Fixture) -> DataFrame:
    after = uploads.job_completion(fx.jobs, fx.upload_headers, fx.upload_cells, fx.row_results, NOW_MS)
    return after.select("id", "status", "succeeded", "output_key", "updated_at")


OUTPUT_LINES = f"""{COMPLETE},
lines AS (SELECT job_id, 0 AS line_no, 'Site,Product,Price (SEK),Link,Beskrivning,Varför' AS line FROM complete
UNION ALL SELECT u.job_id, u.row_index + 1, '"butik, 1",' || CSV(u.product) || ',' || u.row_index * 10 || ',,' || CSV(r.beskrivning) || ',' || CSV(r.varfor)
 FROM upload_rows u JOIN complete USING (job_id) LEFT JOIN row_results r ON r.job_id = u.job_id AND r.row_index = u.row_index)"""


def output_lines(fx: Fixture) -> DataFrame:
    return uploads.job_output_lines(fx.upload_headers, fx.upload_cells, fx.row_results)


@query("job_output_csv", f"WITH {OUTPUT_LINES} SELECT * FROM lines")
def _job_output_csv(fx: Fixture) -> DataFrame:
    return output_lines(fx)


def written_files(fx: Fixture, location: str) -> DataFrame:
    """(job_id, length, content) of the files written there."""
    found = fx.spark.read.format("binaryFile").load(location)
    return found.select(F.regexp_extract("path", rf"(\d+){OUTPUT_SUFFIX}$", 1).cast("long").alias("job_id"), "length", "content")


@query(
    "job_output_files",
    f"""WITH {OUTPUT_LINES}
SELECT job_id, strlen(string_agg(line, chr(13) || chr(10) ORDER BY line_no)) AS bytes FROM lines GROUP BY job_id""",
)
def _job_output_files(fx: Fixture) -> DataFrame:
    location = shared_dir(fx.spark, "job-files")
    write_job_files(output_lines(fx), location)
    return written_files(fx, location).select("job_id", F.col("length").alias("bytes"))


WORKLIST = """
SELECT event_id AS id, user_id, CASE WHEN event_type = 'view' THEN {ms} + event_id % 40 * 86400000 ELSE NULL END AS resume_at,
 CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 1706659199000 ELSE 1706659199001 END AS deferred_at FROM events"""


@query(
    "ready_worklist",
    f"""WITH work AS ({WORKLIST.replace('{ms}', '(epoch_us(ts)//1000)')}),
timed AS (SELECT *, CASE WHEN resume_at IS NOT NULL THEN greatest(resume_at, deferred_at + 1000) END AS not_before FROM work)
SELECT * FROM timed WHERE not_before IS NULL OR not_before <= {{now}}""",
)
def _ready_worklist(fx: Fixture) -> DataFrame:
    sql = WORKLIST.replace("{ms}", "unix_millis(cast(ts AS timestamp))").replace("FROM events", "FROM {events}")
    return uploads.ready_worklist(fx.spark.sql(sql, events=fx.events), NOW_MS)
