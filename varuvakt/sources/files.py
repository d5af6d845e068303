"""Uploaded files as tables.

Everything here takes a DataFrame shaped like Spark's ``binaryFile`` source
(path, length, content). A file larger than the upload cap is refused with an
error, so one file is at most 50 MiB and fits one row; parallelism is over files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted suffixes, the size cap, the field names of an empty workbook.
SUFFIXES = (".csv", ".docx", ".pdf", ".txt", ".xlsx")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
ROW_FIELDS = ("Site", "Product", "Price (SEK)", "Link")
#: An office file that unpacks past this is not read.
MAX_UNPACKED_BYTES = 512 * 1024 * 1024
TOO_LARGE, UNREADABLE = "too_large", "unreadable"

ROWS_SCHEMA = "path string, fieldnames array<string>, rows array<array<string>>, error string"


def read_uploads(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)


def suffix_of(path: Column) -> Column:
    """Lower-cased text from the last dot of the file name on; the last character when there is no dot."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(
        F.right(name, F.lit(1))
    )


def upload_manifest(files: DataFrame) -> DataFrame:
    """Which files become jobs. Only path and length are read, never the content."""
    suffix = suffix_of(F.col("path"))
    reason = F.when(~suffix.isin(*SUFFIXES), "unsupported_type").when(
        F.col("length") > MAX_UPLOAD_BYTES, "too_large"
    )
    return files.select("path", "length", suffix.alias("suffix"), reason.alias("reject_reason")).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), "queued").otherwise("refused")
    )


def accepted(files: DataFrame, *suffixes: str) -> DataFrame:
    """``(path, content, error)`` of the files of these kinds; one past the upload cap keeps its row, without content."""
    too_large = F.coalesce(F.col("length") > MAX_UPLOAD_BYTES, F.lit(False))
    return files.filter(suffix_of(F.col("path")).isin(*suffixes)).select(
        "path", F.when(~too_large, F.col("content")).alias("content"), F.when(too_large, TOO_LARGE).alias("error")
    )


def decode_utf8(content: Column) -> Column:
    """Text of a file: invalid bytes become U+FFFD, a byte order mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def _split_line(line: Column) -> Column:
    """Cells of one CSV line; a quote opens and closes quoting anywhere in a cell."""
    segment = r'"[^"]*+(?:""[^"]*+)*+"?'
    # A leading comma makes every cell start with one, so the first needs no special case.
    cells = F.regexp_extract_all(
        F.concat(F.lit(","), line), F.lit(rf',((?:[^",]++|{segment})*+)'), 1
    )
    return F.transform(cells, lambda c: F.when(~F.contains(c, F.lit('"')), c).otherwise(_unquoted(c)))


def _unquoted(cell: Column) -> Column:
    """A cell without its enclosing quotes; a doubled quote inside quoting is one quote.

    Walking a cell, segments alternate: outside, quoted, outside ... Splitting on
    the quote character, an empty piece at an even position between two quoted
    pieces means the quotes touched, that is, an escaped quote.
    """

    def joined(pieces: Column) -> Column:
        touched = lambda p, i: (i % 2 == 0) & (i > 0) & (i < F.size(pieces) - 1) & (p == "")
        return F.array_join(F.transform(pieces, lambda p, i: F.when(touched(p, i), F.lit('"')).otherwise(p)), "")

    # The pieces are a lambda's variable, so the cell is split once and not once per piece.
    return F.get(F.transform(F.array(F.split(cell, '"', -1)), joined), F.lit(0))


def csv_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)`` of CSV files.

    The first non-empty line names the fields. Blank lines are dropped, short
    rows padded with empty text, extra cells dropped; a field named twice shows
    its last value in both places. A quoted field cannot span lines.
    """
    text = decode_utf8(F.col("content"))
    lines = F.filter(F.split(text, "\r?\n", -1), lambda line: line != "")
    parsed = accepted(files, ".csv").select("path", "error", F.transform(lines, _split_line).alias("_cells"))
    named = parsed.select(
        "path",
        "error",
        F.coalesce(F.get("_cells", F.lit(0)), F.array().cast("array<string>")).alias("fieldnames"),
        F.when(F.size("_cells") > 1, F.slice("_cells", F.lit(2), F.size("_cells") - 1)).alias("rows"),
    )
    return _headers_and_rows(named)


def _headers_and_rows(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers (path, fieldnames, error: why a file gives no rows) and rows (path, row_index, cells)."""
    width = F.size("fieldnames")
    # Where each field's value stands is found once per file, before its rows are unfolded.
    places = F.transform("fieldnames", lambda name: width - F.array_position(F.reverse("fieldnames"), name).cast("int"))
    cells = F.transform("places", lambda at: F.coalesce(F.get("values", at), F.lit("")))
    rows = (
        named.select("path", places.alias("places"), "rows")
        .select("path", "places", F.posexplode("rows").alias("row_index", "values"))
        .select("path", F.col("row_index").cast("long").alias("row_index"), cells.alias("cells"))
    )
    return named.select("path", "fieldnames", "error"), rows


def _cell_text(cell: ElementTree.Element, ns: str, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{ns}t"))
    value = cell.findtext(f"{ns}v")
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n":
        return _number_text(float(value))
    return value


def _number_text(number: float) -> str:
    """A number without needless fraction, and without exponent between 1e-6 and 1e21."""
    if number.is_integer() and abs(number) < 1e21:
        return str(int(number))
    if 1e-6 <= abs(number) < 1e21:
        return format(Decimal(repr(number)), "f")
    return re.sub(r"e([+-])0+(?=\d)", r"e\1", repr(number))


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n


def _first_sheet(content: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a workbook's first sheet, cells as text, empty rows left out."""
    with _archive(content) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            ns = root.tag[: root.tag.index("}") + 1]
            shared = ["".join(t.text or "" for t in item.iter(f"{ns}t")) for item in root.iter(f"{ns}si")]
        workbook = ElementTree.fromstring(book.read("xl/workbook.xml"))
        first = next(el for el in workbook.iter() if el.tag.endswith("}sheet"))
        rel_id = next(v for k, v in first.attrib.items() if k.endswith("}id"))
        rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == rel_id)
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        sheet = ElementTree.fromstring(book.read(path))
    ns = sheet.tag[: sheet.tag.index("}") + 1]
    grid: dict[int, dict[int, str | None]] = {}
    row_no = 0
    for row in sheet.iter(f"{ns}row"):
        row_no = int(row.get("r", row_no + 1))
        col_no = 0
        for cell in row.iter(f"{ns}c"):
            col_no = _column_number(cell.get("r")) if cell.get("r") else col_no + 1
            text = _cell_text(cell, ns, shared)
            if text is not None:
                grid.setdefault(row_no, {})[col_no] = text
    if not grid:
        return list(ROW_FIELDS), []
    columns = range(min(min(r) for r in grid.values()), max(max(r) for r in grid.values()) + 1)
    table = [[grid[r].get(c) or "" for c in columns] for r in sorted(grid)]
    return table[0], table[1:]


def _archive(content: bytes) -> zipfile.ZipFile:
    """An office file's archive; one that would unpack past MAX_UNPACKED_BYTES is refused."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    if sum(entry.file_size for entry in archive.infolist()) > MAX_UNPACKED_BYTES:
        raise OverflowError("unpacks past the bound")
    return archive


def _guarded(parse: Callable[[bytes], object], contents: Iterable[bytes | None], errors: Iterable[str | None]) -> list[tuple]:
    """``(result, error)`` per file, so that a broken file ends neither the task nor the files beside it."""
    out = []
    for content, error in zip(contents, errors):
        if content is None:
            out.append((None, error or UNREADABLE))
            continue
        try:
            out.append((parse(content), None))
        except OverflowError:
            out.append((None, TOO_LARGE))
        except Exception:  # noqa: BLE001 - whatever is wrong with an uploaded file is that file's outcome
            out.append((None, UNREADABLE))
    return out


def xlsx_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)`` of the first sheet of workbooks; a refused or broken one has an ``error`` and no fields."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = _guarded(_first_sheet, batch["content"], batch["error"])
            sheets = [sheet or ([], []) for sheet, _ in parsed]
            yield pd.DataFrame(
                {
                    "path": batch["path"].to_numpy(),
                    "fieldnames": [s[0] for s in sheets],
                    "rows": [s[1] for s in sheets],
                    "error": pd.Series([error for _, error in parsed], dtype=object),
                }
            )

    return _headers_and_rows(accepted(files, ".xlsx").mapInPandas(parse, ROWS_SCHEMA))


def _paragraphs(content: bytes) -> str:
    """Raw text of a word-processor document: every paragraph followed by an empty line.

    A paragraph inside another (a text box) stands once, at its place in the outer
    one. Of content stored in two forms for newer and older readers the older is taken.
    """
    with _archive(content) as doc:
        root = ElementTree.fromstring(doc.read("word/document.xml"))
    out = []

    def walk(element: ElementTree.Element) -> None:
        name = element.tag.rpartition("}")[2]
        if name == "Choice":
            return
        if name == "t":
            out.append(element.text or "")
        elif name == "tab" and not element.attrib:
            out.append("\t")
        for child in element:
            walk(child)
        if name == "p":
            out.append("\n\n")

    for child in root:
        walk(child)
    return "".join(out)


def text_docs(files: DataFrame) -> DataFrame:
    """``(path, text, error)`` of text and word-processor files, whole; a refused or broken file has an error and no text."""
    plain = accepted(files, ".txt").select("path", decode_utf8(F.col("content")).alias("text"), "error")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = _guarded(_paragraphs, batch["content"], batch["error"])
            texts, errors = (pd.Series([p[k] for p in parsed], dtype=object) for k in (0, 1))
            yield pd.DataFrame({"path": batch["path"].to_numpy(), "text": texts, "error": errors})

    rich = accepted(files, ".docx").mapInPandas(parse, "path string, text string, error string")
    return plain.unionByName(rich)
