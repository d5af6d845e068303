import io
import os
import random
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from varuvakt.operators import uploads
from varuvakt.plans.office import document, workbook
from varuvakt.schemas import TABLES
from varuvakt.session import apply_settings
from varuvakt.sources import exports, file_sinks, files


def uploaded(spark, tmp_path, **contents):
    for name, data in contents.items():
        (tmp_path / name.replace("__", ".")).write_bytes(data)
    return files.read_uploads(spark, str(tmp_path))


def stems(df, *cols):
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return sorted((tuple(r) for r in df.select(name, *cols).collect()), key=repr)


def test_csv_file(spark, tmp_path):
    text = '﻿Site,Product,Price (SEK),Link\r\n"a, b","säg ""hej""",10\r\n\r\nx,y,1,z,extra\nd"e,f"g,h\n,,,\n'
    headers, rows = files.csv_rows(uploaded(spark, tmp_path, rader__csv=text.encode(), tom__csv=b"\n", bara__csv=b"A,A\n1,2\n"))
    assert stems(headers, "fieldnames") == [("bara.csv", ["A", "A"]), ("rader.csv", ["Site", "Product", "Price (SEK)", "Link"]), ("tom.csv", [])]
    assert stems(rows, "row_index", "cells") == [
        ("bara.csv", 0, ["2", "2"]), ("rader.csv", 0, ["a, b", 'säg "hej"', "10", ""]), ("rader.csv", 1, ["x", "y", "1", "z"]),
        ("rader.csv", 2, ["de,fg", "h", "", ""]), ("rader.csv", 3, ["", "", "", ""])]


def toggled(line):
    """Character by character: a quote switches quoting, two inside quoting are one."""
    cells, cell, inside, i = [], "", False, 0
    while i < len(line):
        ch = line[i]
        if inside and line[i : i + 2] == '""':
            cell, i = cell + '"', i + 1
        elif ch == '"':
            inside = not inside
        elif ch == "," and not inside:
            cells.append(cell)
            cell = ""
        else:
            cell += ch
        i += 1
    return [*cells, cell]


def test_csv_lines_match_a_character_walk(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('a",b') for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(line,) for line in lines], "line string").select("line", files._split_line(F.col("line")).alias("cells"))
    assert [(r.line, r.cells) for r in df.collect() if r.cells != toggled(r.line)] == []


def test_workbook(spark, tmp_path):
    table = [["Site", None, "Pris"], [], ["a", "b & <c>", 10.0], [None, True, 1.5], [None, "", None], ["å", None, None]]
    books = {"delad__xlsx": workbook([table, [["annat"]]]), "egen__xlsx": workbook([table], shared=False), "tom__XLSX": workbook([[]])}
    headers, rows = files.xlsx_rows(uploaded(spark, tmp_path, **books))
    assert stems(headers, "fieldnames") == [(n, ["Site", "", "Pris"]) for n in ("delad.xlsx", "egen.xlsx")] + [("tom.XLSX", list(files.ROW_FIELDS))]
    want = [["a", "b & <c>", "10"], ["", "true", "1.5"], ["", "", ""], ["å", "", ""]]
    assert stems(rows, "row_index", "cells") == [(n, i, c) for n in ("delad.xlsx", "egen.xlsx") for i, c in enumerate(want)]


def test_texts_and_manifest(spark, tmp_path):
    df = uploaded(spark, tmp_path, a__txt="åäö\n".encode() + b"\xff", b__docx=document(["ett", "", "två & tre"]), c__pdf=b"x", d__exe=b"x", namn=b"x")
    assert stems(files.text_docs(df), "text") == [("a.txt", "åäö\n�"), ("b.docx", "ett\n\n\n\ntvå & tre\n\n")]
    got = stems(files.upload_manifest(df), "suffix", "status", "reject_reason")
    assert got == [("a.txt", ".txt", "queued", None), ("b.docx", ".docx", "queued", None), ("c.pdf", ".pdf", "queued", None),
                   ("d.exe", ".exe", "refused", "unsupported_type"), ("namn", "n", "refused", "unsupported_type")]
    big = spark.createDataFrame([("x/a.csv", files.MAX_UPLOAD_BYTES), ("x/b.csv", files.MAX_UPLOAD_BYTES + 1)], "path string, length long")
    assert stems(files.upload_manifest(big), "status") == [("a.csv", "queued"), ("b.csv", "refused")]


def jobs_world(spark):
    jobs = spark.createDataFrame([(i, 7, s, "f.csv", None, None, "", 0, 0, None, 0, 0) for i, s in [(1, "processing"), (2, "processing"), (3, "done"), (4, "queued"), (5, "paused")]], TABLES["jobs"])
    headers = spark.createDataFrame([(i, ["Site", "Product"]) for i in (1, 2, 3, 5)], "job_id long, fieldnames array<string>")
    rows = spark.createDataFrame([(1, 0, ["a,b", 'q"r']), (1, 1, ["c", "d"]), (2, 0, ["x", "y"]), (2, 1, ["x", "z"]), (3, 0, ["k", "l"])], "job_id long, row_index long, cells array<string>")
    results = spark.createDataFrame([(1, 0, "rad\n1", "v"), (1, 1, "", ""), (2, 0, "t", "u"), (3, 0, "t", "u")], "job_id long, row_index long, beskrivning string, varfor string")
    return jobs, headers, rows, results


def test_completion(spark, rows):
    jobs, headers, cells, results = jobs_world(spark)
    got = rows(uploads.job_completion(jobs, headers, cells, results, 99), "id", "status", "succeeded", "output_key", "updated_at")
    assert got == [(1, "done", 1, "7/1_med_beskrivning.csv", 99), (2, "processing", 0, None, 0), (3, "done", 0, None, 0), (4, "queued", 0, None, 0),
                   (5, "done", 0, "7/5_med_beskrivning.csv", 99)]
    assert rows(uploads.pending_rows(cells, results), "job_id", "row_index") == [(2, 1)]


def test_finished_files_are_byte_exact(spark, rows, tmp_path):
    _, headers, cells, results = jobs_world(spark)
    lines = uploads.job_output_lines(headers, cells, results)
    exports.write_job_files(lines, str(tmp_path / "ut"))
    exports.write_job_files(lines, str(tmp_path / "ut"))
    content = (tmp_path / "ut" / "1_med_beskrivning.csv").read_bytes().decode()
    assert content == 'Site,Product,Beskrivning,Varför\r\n"a,b","q""r","rad\n1",v\r\nc,d,,'
    assert (tmp_path / "ut" / "5_med_beskrivning.csv").read_bytes().decode() == "Site,Product,Beskrivning,Varför"
    assert sorted(os.listdir(tmp_path)) == ["ut"] and len(os.listdir(tmp_path / "ut")) == 3


def test_long_job_and_failed_write(spark, tmp_path):
    lines = spark.range(300_000).selectExpr("9L AS job_id", "299999 - id AS line_no", "concat('rad ', 299999 - id) AS line")
    exports.write_job_files(lines, str(tmp_path / "ut"))
    assert (tmp_path / "ut" / "9_med_beskrivning.csv").read_text() == "\n".join(f"rad {k}" for k in range(300_000))
    assert (tmp_path / "ut" / "9_med_beskrivning.csv").read_bytes().count(b"\r\n") == 299_999
    broken = lines.withColumn("line", F.expr("if(line_no = 7, raise_error('x'), line)"))
    with pytest.raises(Exception):
        exports.write_job_files(broken, str(tmp_path / "fel"))
    exports.write_job_files(lines.limit(0), str(tmp_path / "tom"))
    assert sorted(os.listdir(tmp_path)) == ["tom", "ut"] and os.listdir(tmp_path / "tom") == []


def test_row_results_last_write_wins(spark, rows):
    _, _, _, results = jobs_world(spark)
    late = spark.createDataFrame([(1, 0, 1, "ett", "a"), (1, 0, 2, None, None), (2, 1, 1, "ny", None)], "job_id long, row_index long, ord long, beskrivning string, varfor string")
    got = rows(uploads.merge_row_results(results, late))
    assert got == [(1, 0, "", ""), (1, 1, "", ""), (2, 0, "t", "u"), (2, 1, "ny", ""), (3, 0, "t", "u")]


def test_product_export(spark, tmp_path):
    cols = "id long, url string, title string, current_price long, category string, description string, first_seen long, last_updated long"
    products = spark.createDataFrame([(2, "u2", 'a "b", c', None, None, "text", 1, 2), (1, "u1", None, 5, "k", None, 1, 2)], cols)
    table = exports.export_products(products)
    exports.write_csv(table, exports.PRODUCT_FIELDS, str(tmp_path / "produkter.csv"))
    data = (tmp_path / "produkter.csv").read_bytes().decode()
    assert data == 'id,url,title,current_price,category,has_description,first_seen,last_updated\r\n1,u1,,5,k,0,1,2\r\n2,u2,"a ""b"", c",,,1,1,2\r\n'
    many = spark.range(5000).selectExpr("id", "concat('u', id) AS url").repartition(7).orderBy("id")
    exports.write_csv(many, ("id", "url"), str(tmp_path / "alla.csv"))
    assert (tmp_path / "alla.csv").read_bytes().decode() == "id,url\r\n" + "".join(f"{k},u{k}\r\n" for k in range(5000))
    exports.write_json(table.coalesce(1), str(tmp_path / "json"))
    schema = "id long, title string, has_description int"
    assert [tuple(r) for r in exports.read_ndjson(spark, str(tmp_path / "json"), schema).collect()] == [(1, None, 0), (2, 'a "b", c', 1)]


def test_ready_worklist(spark, rows):
    work = spark.createDataFrame([(1, None, None), (2, 100, None), (3, 101, None), (4, 50, 99), (5, 50, 100), (6, None, 100)], "id int, resume_at long, deferred_at long")
    got = rows(uploads.ready_worklist(work.selectExpr("id", "resume_at", "deferred_at * 1L as deferred_at"), 1099), "id", "not_before")
    assert got == [(1, None), (2, 100), (3, 101), (4, 1099), (6, None)]


def test_uploads_become_jobs_and_move_on(spark, rows):
    jobs = jobs_world(spark)[0]
    asked = spark.createDataFrame([(7, "in/a.csv", "a.csv", None, ""), (8, "in/b.txt", "b.txt", ("saklig", "", ""), "x")],
                                  "account_id long, path string, filename string, options struct<tone:string,length:string,audience:string>, custom_direction string")
    fresh = uploads.queue_uploads(jobs, asked, 50)
    assert sorted(r[0] for r in rows(fresh, "id")) == [6, 7]
    assert rows(fresh, "account_id", "status", "filename", "total", "created_at") == [(7, "queued", "a.csv", 0, 50), (8, "queued", "b.txt", 0, 50)]
    outcomes = spark.createDataFrame([(4, "extracted", 3, None), (5, "deferred", 0, None), (1, "extracted", 9, None), (3, "failed", 0, "x")],
                                     "job_id long, outcome string, rows long, message string")
    after = uploads.apply_extraction(jobs, outcomes, 60)
    assert rows(after, "id", "status", "total", "error_message") == [(1, "processing", 0, None), (2, "processing", 0, None), (3, "done", 0, None),
                                                                    (4, "processing", 3, None), (5, "paused", 0, None)]
    failed = uploads.apply_extraction(after, spark.createDataFrame([(5, "no_match", 0, "inget")], "job_id long, outcome string, rows long, message string"), 70)
    assert rows(failed.filter("id = 5"), "status", "error_message", "updated_at") == [("error", "inget", 70)]


def test_arrow_locations():
    assert [file_sinks.arrow_uri(u) for u in ("/a/b", "file:/a", "file:///a", "s3a://b/c", "hdfs://n/a")] == ["/a/b", "/a", "/a", "s3://b/c", "hdfs://n/a"]


def test_many_doubled_quotes_and_nul(spark):
    cell = '"' + '""' * 200_000 + '"'
    df = spark.createDataFrame([(f"{cell},x",), ('"a\x00b",c',)], "line string")
    started = time.time()
    got = [r.cells for r in df.select(files._split_line(F.col("line")).alias("cells")).collect()]
    assert got == [['"' * 200_000, "x"], ["a\x00b", "c"]] and time.time() - started < 30


def test_broken_and_large_files_have_an_error(spark, tmp_path):
    good = workbook([[["A"], ["1"]]])
    df = uploaded(spark, tmp_path, ok__xlsx=good, bad__xlsx=b"PK not a workbook", bad__docx=b"x", ok__docx=document(["ett"]))
    headers, rows = files.xlsx_rows(df)
    assert stems(headers, "fieldnames", "error") == [("bad.xlsx", [], "unreadable"), ("ok.xlsx", ["A"], None)]
    assert stems(rows, "cells") == [("ok.xlsx", ["1"])]
    assert stems(files.text_docs(df), "text", "error") == [("bad.docx", None, "unreadable"), ("ok.docx", "ett\n\n", None)]
    big = spark.createDataFrame([(f"x/a.{k}", files.MAX_UPLOAD_BYTES + 1, bytearray(b"a")) for k in ("csv", "xlsx", "txt", "docx")], "path string, length long, content binary")
    assert [stems(h, "fieldnames", "error") for h in (files.csv_rows(big)[0], files.xlsx_rows(big)[0])] == [[("a.csv", [], "too_large")], [("a.xlsx", [], "too_large")]]
    assert stems(files.text_docs(big), "text", "error") == [("a.docx", None, "too_large"), ("a.txt", None, "too_large")]
    assert files.csv_rows(big)[1].count() == files.xlsx_rows(big)[1].count() == 0


def test_nested_paragraphs_stand_once():
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    inner = "<w:p><w:r><w:t>INRE</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>yttre</w:t>{inner}</w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as doc:
        doc.writestr("word/document.xml", body)
    assert files._paragraphs(data.getvalue()) == "yttreINRE\n\n\n\n"


def test_cell_numbers():
    assert [files._number_text(x) for x in (10.0, 1.5, 0.00005, 1e-7, 1e21, -0.25)] == ["10", "1.5", "0.00005", "1e-7", "1e+21", "-0.25"]


def test_python_takes_files_by_bytes(spark):
    """Large texts come to a Python worker a few at a time, not ten thousand (F5)."""
    apply_settings(spark)

    def held(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [sum(map(len, batch["content"]))]})

    big = spark.range(0, 300, 1, 1).selectExpr("encode(repeat('x', 100000), 'UTF-8') AS content")
    sizes = [r.n for r in big.mapInPandas(held, "n long").collect()]
    assert sum(sizes) == 30_000_000 and max(sizes) <= 9_000_000
