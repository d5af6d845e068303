"""Minimal workbook and document writers, to turn table rows into upload files."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def workbook(sheets: list[list[list[object]]], shared: bool = True) -> bytes:
    """An .xlsx file; each sheet is a list of rows. None is a missing cell, numbers stay numbers."""
    strings: list[str] = []

    def cell(value: object, ref: str) -> str:
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{ref}"><v>{value}</v></c>'
        text = escape(str(value))
        if not shared:
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
        strings.append(text)
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        entries, rels = [], []
        for n, rows in enumerate(sheets, 1):
            body = "".join(
                f'<row r="{r}">' + "".join(cell(v, f"{chr(65 + c)}{r}") for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            book.writestr(
                f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{SHEET_NS}"><sheetData>{body}</sheetData></worksheet>'
            )
            entries.append(f'<sheet name="Blad{n}" sheetId="{n}" r:id="rId{n}"/>')
            rels.append(f'<Relationship Id="rId{n}" Type="worksheet" Target="worksheets/sheet{n}.xml"/>')
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{SHEET_NS}" xmlns:r="{REL_NS}"><sheets>{"".join(entries)}</sheets></workbook>',
        )
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE_NS}">{"".join(rels)}</Relationships>')
        items = "".join(f'<si><t xml:space="preserve">{t}</t></si>' for t in strings)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET_NS}">{items}</sst>')
    return out.getvalue()


def document(paragraphs: list[str]) -> bytes:
    """A .docx file with one text run per paragraph."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as doc:
        doc.writestr("word/document.xml", f'<w:document xmlns:w="{WORD_NS}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
