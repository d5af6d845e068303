"""The whole way of uploads: stored files, rows, texts, finished files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varuvakt.functions.prompts import EXTRACTION_PROMPT, TONES
from varuvakt.functions.text import csv_line
from varuvakt.operators.upload_flow import Uploads, output_lines, upload_round
from varuvakt.operators.uploads import queue_uploads
from varuvakt.plans.fixtures import NOW_MS, Fixture
from varuvakt.plans.office import workbook
from varuvakt.plans.queries.files import written_files
from varuvakt.plans.registry import query
from varuvakt.session import shared_dir, written
from varuvakt.sources.exports import write_job_files
from varuvakt.sources.files import ROW_FIELDS, upload_manifest

# Uploaded rows cut into files of at most 500; the kind of the file follows from the job, and one in ten is of a kind that has no reader.
UPLOADED = """
SELECT job_id, row_index, concat('in/', cast(job_id AS {s}), '-', cast(row_index {div} 500 AS {s}),
  CASE WHEN job_id % 10 = 9 THEN '.pdf' WHEN job_id % 3 = 0 THEN '.csv' WHEN job_id % 3 = 1 THEN '.xlsx' ELSE '.txt' END) AS path,
 replace(product, '{nl}', ' ') AS product, row_index * 10 AS price FROM {rows}"""
SITE = 'butik "1", nord'


def upload_files(fx: Fixture) -> DataFrame:
    """Files as ``binaryFile`` gives them."""
    rows = fx.spark.sql(UPLOADED.format(s="string", div="div", nl="\\n", rows="{rows}"), rows=fx.upload_rows)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents = []
            for path, entries in zip(batch["path"], batch["entries"]):
                if path.endswith(".xlsx"):
                    contents.append(workbook([[list(ROW_FIELDS), *([SITE, e["product"], int(e["price"]), None] for e in entries)]]))
                else:
                    head = [",".join(ROW_FIELDS)] if path.endswith(".csv") else []
                    contents.append("\r\n".join(head + [e["line"] for e in entries]).encode("utf-8"))
            yield pd.DataFrame({"path": batch["path"], "length": [len(c) for c in contents], "content": contents})

    cells = csv_line([F.lit(SITE), F.col("product"), F.col("price")])
    line = F.when(F.col("path").endswith(".csv"), cells).otherwise(F.col("product"))
    entries = F.sort_array(F.collect_list(F.struct("row_index", "product", "price", line.alias("line")))).alias("entries")
    # A file holds at most 500 rows.
    return rows.groupBy("path").agg(entries).mapInPandas(build, "path string, length long, content binary")


def reply(system: str, message: str) -> str:
    """A deterministic generator; it has no answer for names of certain lengths."""
    if system == EXTRACTION_PROMPT:
        return json.dumps([{"Product": line, "Site": "dok"} for line in message.split("\n")], ensure_ascii=False)
    lines = message.split("\n")
    product = lines[0].removeprefix("Produkt: ")
    if len(product) % 11 == 0:
        raise ValueError("no answer")
    tone = next((name for name, text in TONES.items() if text in system), "fri")
    return json.dumps({"beskrivning": f"{product} ({tone})", "varför": "Finns hos " + lines[-2].removeprefix("Butik: ")}, ensure_ascii=False)


@query(
    "upload_pipeline",
    f"""WITH uploaded AS ({UPLOADED.format(s='varchar', div='//', nl='{nl}', rows='upload_rows').replace("'{nl}'", 'chr(10)')}),
named AS (SELECT *, path LIKE '%.txt' AS free, CASE job_id % 3 WHEN 0 THEN 'saklig' WHEN 1 THEN 'lyxig' ELSE 'fri' END AS tone FROM uploaded),
cells AS (SELECT path, tone, row_index, CASE WHEN free THEN 'dok' ELSE '{SITE}' END AS site, CASE WHEN free THEN TRIM(product) ELSE product END AS product,
 CASE WHEN free THEN '' ELSE price::varchar END AS price FROM named WHERE path NOT LIKE '%.pdf' AND NOT (free AND TRIM(product) = '')),
answered AS (SELECT *, length(product) % 11 <> 0 AS ok, row_number() OVER (PARTITION BY path ORDER BY row_index) AS line_no FROM cells),
results AS (SELECT *, CASE WHEN ok THEN TRIM(product || ' (' || tone || ')') ELSE '' END AS beskrivning, CASE WHEN ok THEN 'Finns hos ' || site ELSE '' END AS varfor FROM answered),
lines AS (SELECT path, line_no, CSV(site) || ',' || CSV(product) || ',' || price || ',,' || CSV(beskrivning) || ',' || CSV(varfor) AS line FROM results
 UNION ALL SELECT DISTINCT path, 0, 'Site,Product,Price (SEK),Link,Beskrivning,Varför' FROM results),
contents AS (SELECT path, string_agg(line, chr(13) || chr(10) ORDER BY line_no) AS content FROM lines GROUP BY path),
counts AS (SELECT path, count(*) AS total, count(*) FILTER (beskrivning <> '') AS succeeded FROM results GROUP BY path)
SELECT split_part(u.path, '/', 2) AS filename, CASE WHEN c.path IS NULL THEN 'error' ELSE 'done' END AS status, coalesce(n.total, 0) AS total,
 coalesce(n.succeeded, 0) AS succeeded, CASE WHEN c.path IS NULL THEN 'unsupported' END AS error_message, strlen(c.content) AS bytes, md5(c.content) AS digest
FROM (SELECT DISTINCT path FROM uploaded) u LEFT JOIN contents c USING (path) LEFT JOIN counts n USING (path)""",
)
def _upload_pipeline(fx: Fixture) -> DataFrame:
    files = written(upload_files(fx), "upload-files")
    job = F.regexp_extract("path", r"in/(\d+)-", 1).cast("long")
    tone = F.when(job % 3 == 0, "saklig").when(job % 3 == 1, "lyxig").otherwise("okänd")
    asked = upload_manifest(files).where("status = 'queued'").select(
        (job % 7).alias("account_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.struct(tone.alias("tone"), F.lit("kort").alias("length"), F.lit("").alias("audience")).alias("options"), F.lit("").alias("custom_direction"),
    )
    jobs = fx.jobs.withColumns({"options": F.struct("tone", "length", "audience"), "path": F.lit(None).cast("string")}).drop("tone", "length", "audience")
    queued = written(queue_uploads(jobs, asked, NOW_MS), "upload-queue")
    texts = "job_id long, row_index long, beskrivning string, varfor string"
    none = [fx.spark.createDataFrame([], s) for s in ("job_id long, fieldnames array<string>", "job_id long, row_index long, cells array<string>", texts)]
    state, _ = upload_round(Uploads(queued, *none), files, reply, NOW_MS)
    location = shared_dir(fx.spark, "upload-output")
    write_job_files(output_lines(state), location)
    finished = written_files(fx, location).select(F.col("job_id").alias("id"), F.col("length").alias("bytes"), F.md5("content").alias("digest"))
    return state.jobs.join(finished, "id", "left").select("filename", "status", "total", "succeeded", "error_message", "bytes", "digest")
