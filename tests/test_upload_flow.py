import json

from pyspark.sql import functions as F

from varuvakt.functions.prompts import BASE_PROMPT, EXTRACTION_PROMPT, TONES
from varuvakt.operators.describe import QuotaExhausted
from varuvakt.operators.upload_flow import Uploads, output_lines, upload_round
from varuvakt.operators.uploads import queue_uploads
from varuvakt.plans.office import document, workbook
from varuvakt.schemas import TABLES
from varuvakt.sources.exports import write_job_files
from varuvakt.sources.files import read_uploads, upload_manifest


def generator(spent):
    """Answers with the tone it was asked for; no quota for products in ``spent``; a product named 'fel' fails."""

    def generate(system, message):
        if system == EXTRACTION_PROMPT:
            if "vänta" in message and "vänta" in spent:
                raise QuotaExhausted(500)
            return json.dumps([{"Product": line, "Site": "s"} for line in message.split("\n") if line and line != "tomt"])
        product = message.split("\n")[0].removeprefix("Produkt: ")
        if product in spent:
            raise QuotaExhausted(700)
        if product == "fel":
            raise RuntimeError(product)
        tone = next((name for name, text in TONES.items() if text in system), "fri")
        assert system.startswith(BASE_PROMPT)
        return json.dumps({"beskrivning": f"{product}, {tone}", "varför": message.split("\n")[-2]})

    return generate


def test_uploads_from_file_to_file(spark, tmp_path):
    contents = {
        "a.csv": 'Price (SEK),Product,Färg\n10,"stol, röd",x\n20,fel\n'.encode(), "b.xlsx": workbook([[["Site", "Product"], ["butik", "bord"]]]),
        "c.txt": "lampa\nmatta".encode(), "d.docx": document(["vänta"]), "e.txt": b"tomt", "f.xlsx": b"no workbook", "g.pdf": b"x", "h.csv": b"A,B\n", "i.csv": b"",
        "z.csv": b"Product\nej med\n",
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = read_uploads(spark, str(tmp_path))
    jobs = spark.createDataFrame([], TABLES["jobs"] + ", path string")
    tone = F.when(F.col("path").endswith("a.csv"), "saklig").otherwise("")
    asked = upload_manifest(files).where("status = 'queued' AND path NOT LIKE '%z.csv'").select(
        F.lit(7).cast("long").alias("account_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.struct(tone.alias("tone"), F.lit("").alias("length"), F.lit("").alias("audience")).alias("options"), F.lit("").alias("custom_direction"),
    )
    gone = asked.limit(1).withColumns({"path": F.lit("borta.csv"), "filename": F.lit("borta.csv")})
    state = Uploads(
        queue_uploads(jobs, asked.unionByName(gone), 1),
        spark.createDataFrame([], "job_id long, fieldnames array<string>"),
        spark.createDataFrame([], "job_id long, row_index long, cells array<string>"),
        spark.createDataFrame([], "job_id long, row_index long, beskrivning string, varfor string"),
    )
    state, left = upload_round(state, files, generator({"vänta", "bord"}), 10)

    def standing():
        return {r.filename: (r.status, r.total, r.succeeded, r.error_message) for r in state.jobs.collect()}

    first = standing()
    assert first == {
        "a.csv": ("done", 2, 1, None), "b.xlsx": ("processing", 1, 0, None), "c.txt": ("done", 2, 2, None), "d.docx": ("paused", 0, 0, None),
        "e.txt": ("error", 0, 0, "no_products"), "f.xlsx": ("error", 0, 0, "unreadable"), "g.pdf": ("error", 0, 0, "unsupported"),
        "h.csv": ("done", 0, 0, None), "borta.csv": ("error", 0, 0, "missing"),
    }
    assert [(r.row_index, r.resume_at) for r in left.collect()] == [(0, 700)]
    state, left = upload_round(state, files, generator(set()), 20)
    assert standing() == first | {"b.xlsx": ("done", 1, 1, None), "d.docx": ("done", 1, 1, None)} and left.count() == 0

    out = tmp_path / "ut"
    write_job_files(output_lines(state), str(out))
    ids = {r.filename: r.id for r in state.jobs.collect()}
    text = {name: p.read_bytes().decode() for name, i in ids.items() if (p := out / f"{i}_med_beskrivning.csv").exists()}
    assert text == {
        "a.csv": 'Price (SEK),Product,Färg,Beskrivning,Varför\r\n10,"stol, röd",x,"stol, röd, saklig",Butik:\r\n20,fel,,,',
        "b.xlsx": "Site,Product,Beskrivning,Varför\r\nbutik,bord,\"bord, fri\",Butik: butik",
        "c.txt": 'Site,Product,Price (SEK),Link,Beskrivning,Varför\r\ns,lampa,,,"lampa, fri",Butik: s\r\ns,matta,,,"matta, fri",Butik: s',
        "d.docx": 'Site,Product,Price (SEK),Link,Beskrivning,Varför\r\ns,vänta,,,"vänta, fri",Butik: s', "h.csv": "A,B,Beskrivning,Varför",
    }
