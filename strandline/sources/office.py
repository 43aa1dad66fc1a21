"""Workbooks and word-processor files: their archives' parts, pulled apart element by element.

A file's bytes come from any store that Spark reads (``files.read_files``). Parts are read as streams and elements are let go as
they are done, so that a sheet's rows are in memory once, as cells. A file that can't be read raises ValueError with the
reason; ``files.parse_checked`` makes a row of it.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

# Number formats of dates and times by their built-in ids, and the first day of their count.
DATES, TIMES = {14, 15, 16, 17, 22}, {18, 19, 20, 21, 45, 46, 47}
EPOCH = dt.datetime(1899, 12, 30)
RELATED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def archive(content: bytes) -> zipfile.ZipFile:
    if not content.startswith(b"PK"):
        raise ValueError("not an archive")
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise ValueError("the archive is cut off") from None


def _pull(files: zipfile.ZipFile, part: str, wanted: set[str]) -> Iterator:
    """The elements of a part named in ``wanted``, each whole, and let go when the next one is asked for."""
    try:
        with files.open(part) as stream:
            for _, e in ET.iterparse(stream):
                if _name(e) in wanted:
                    yield e
                    e.clear()
    except KeyError:
        raise ValueError(f"no {part} in the archive") from None
    except (ET.ParseError, zipfile.BadZipFile, zlib.error, EOFError) as e:
        raise ValueError(f"{part} is damaged: {type(e).__name__}") from None


def _relations(files: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in files.namelist():
        return {}
    return {e.get("Id"): posixpath.normpath(posixpath.join(folder, e.get("Target"))) if not e.get("Target").startswith("/") else e.get("Target")[1:] for e in _pull(files, path, {"Relationship"})}


def _date_styles(files: zipfile.ZipFile) -> dict[int, str]:
    """The cell styles that show a number as ``date``, ``time`` or ``both``."""
    if "xl/styles.xml" not in files.namelist():
        return {}
    own, out = {}, {}
    for e in _pull(files, "xl/styles.xml", {"numFmt", "cellXfs"}):
        if _name(e) == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower())
            day, hour = bool(re.search(r"[yd]", code)), bool(re.search(r"[hs]", code))
            own[int(e.get("numFmtId"))] = "both" if day and hour else "date" if day else "time" if hour else ""
        else:
            for k, xf in enumerate(e):
                n = int(xf.get("numFmtId", 0))
                out[k] = own.get(n) or ("both" if n == 22 else "date" if n in DATES else "time" if n in TIMES else "")
    return {k: v for k, v in out.items() if v}


def _moment(number: float, shown: str) -> str:
    at = EPOCH + dt.timedelta(seconds=round(number * 86_400))
    return at.strftime({"date": "%Y-%m-%d", "time": "%H:%M:%S", "both": "%Y-%m-%d %H:%M:%S"}[shown])


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook_sheets(content: bytes) -> Iterator[tuple[int, str, list[list[str]]]]:
    """(page from 1, name, rows of cells as text) of each sheet, in the workbook's order. Rows are padded to the widest; empty
    rows are left out. Numbers stay as they are written but for whole ones; dates and times are in ISO form."""
    with archive(content) as files:
        related = _relations(files, "xl/workbook.xml")
        sheets = [(e.get("name"), related.get(e.get(RELATED))) for e in _pull(files, "xl/workbook.xml", {"sheet"})]
        shared = ["".join(t.text or "" for t in e.iter() if _name(t) == "t") for e in _pull(files, "xl/sharedStrings.xml", {"si"})] if "xl/sharedStrings.xml" in files.namelist() else []
        styles = _date_styles(files)

        def cell(c) -> str:
            kind = c.get("t", "n")
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter() if _name(t) == "t")
            value = next((v.text or "" for v in c if _name(v) == "v"), "")
            if not value:
                return ""
            if kind == "s":
                return shared[int(value)] if int(value) < len(shared) else ""
            if kind == "b":
                return "TRUE" if value == "1" else "FALSE"
            if kind == "n":
                shown = styles.get(int(c.get("s", 0)))
                if shown:
                    return _moment(float(value), shown)
                return value[:-2] if re.fullmatch(r"-?\d+\.0", value) else value
            return value

        for page, (name, part) in enumerate(sheets, 1):
            if not part:
                raise ValueError(f"no part for the sheet {name}")
            rows = []
            for r in _pull(files, part, {"row"}):
                own: list[str] = []
                for c in r:
                    if _name(c) != "c":
                        continue
                    at = _column(c.get("r", "")) if c.get("r") else len(own)
                    own += [""] * (at - len(own))
                    own.append(cell(c).strip())
                if any(own):
                    rows.append(own)
            width = max(map(len, rows), default=0)
            yield page, name, [r + [""] * (width - len(r)) for r in rows]


def _heading_styles(files: zipfile.ZipFile) -> dict[str, int]:
    """The paragraph styles that are headings, with their levels."""
    out = {}
    if "word/styles.xml" in files.namelist():
        for e in _pull(files, "word/styles.xml", {"style"}):
            level = next((_attribute(x, "val") for x in e.iter() if _name(x) == "outlineLvl"), None)
            name = next((_attribute(x, "val") or "" for x in e if _name(x) == "name"), "")
            if level is not None and int(level) < 9:
                out[_attribute(e, "styleId")] = int(level) + 1
            elif m := re.fullmatch(r"heading (\d)", name.lower()):
                out[_attribute(e, "styleId")] = int(m[1])
            elif name.lower() == "title":
                out[_attribute(e, "styleId")] = 1
    return out


def _said(p) -> str:
    """A paragraph's text: its runs, with tabs and breaks, without what is deleted."""
    out, gone = [], {id(x) for d in p.iter() if _name(d) == "del" for x in d.iter()}
    for x in p.iter():
        if id(x) not in gone:
            out.append(x.text or "" if _name(x) == "t" else {"tab": "\t", "br": "\n", "cr": "\n"}.get(_name(x), ""))
    return "".join(out).strip()


def document_elements(content: bytes) -> list[tuple]:
    """(kind, text, level, grid, header) of the paragraphs and tables of a word-processor file, in their order. The style says what a
    paragraph is; a table's header is the row marked as such, else the first."""
    with archive(content) as files:
        headings, out = _heading_styles(files), []

        def paragraph(p):
            mark = next((x for x in p if _name(x) == "pPr"), None)
            style = next((_attribute(x, "val") or "" for x in mark if _name(x) == "pStyle"), "") if mark is not None else ""
            listed = mark is not None and any(_name(x) == "numPr" for x in mark)
            outline = next((_attribute(x, "val") for x in mark if _name(x) == "outlineLvl"), None) if mark is not None else None
            level = headings.get(style) or (int(m[1]) if (m := re.fullmatch(r"[Hh]eading(\d)", style)) else None) or (int(outline) + 1 if outline is not None and int(outline) < 9 else None)
            text = _said(p)
            kind = "heading" if level else "caption" if style.lower() == "caption" else "list_item" if listed or style.lower().startswith("list") else "code" if "code" in style.lower() else "paragraph"
            return kind, text, level, None, None

        def table(t):
            rows = [[" ".join(filter(None, (_said(p) for p in c.iter() if _name(p) == "p"))) for c in r if _name(c) == "tc"] for r in t if _name(r) == "tr"]
            marked = next((k for k, r in enumerate(r for r in t if _name(r) == "tr") if any(_name(x) == "tblHeader" for x in r.iter())), 0)
            return ("table", "", None, rows, rows[marked]) if rows else None

        for body in _pull(files, "word/document.xml", {"body"}):
            for e in body:
                made = paragraph(e) if _name(e) == "p" else table(e) if _name(e) == "tbl" else None
                if made:
                    out.append(made)
        return out


def slide_elements(content: bytes) -> list[tuple]:
    """(kind, text, level, grid, header, page) of the slides of a presentation: titles as headings, other paragraphs, tables."""
    with archive(content) as files:
        related, out = _relations(files, "ppt/presentation.xml"), []
        order = [related.get(e.get(RELATED)) for e in _pull(files, "ppt/presentation.xml", {"sldId"})]
        for page, part in enumerate((p for p in order if p), 1):
            for e in _pull(files, part, {"sp", "tbl"}):
                if _name(e) == "tbl":
                    rows = [["".join(t.text or "" for t in c.iter() if _name(t) == "t").strip() for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]
                    if rows:
                        out.append(("table", "", None, rows, rows[0], page))
                    continue
                title = any(_name(x) == "ph" and x.get("type") in ("title", "ctrTitle") for x in e.iter())
                for p in (x for x in e.iter() if _name(x) == "p"):
                    text = "".join(t.text or "" for t in p.iter() if _name(t) == "t").strip()
                    if text:
                        out.append(("heading" if title else "list_item", text, 1 if title else None, None, None, page))
        return out


def _escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = text.replace(a, b)
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as files:
        for name, text in parts.items():
            files.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


MAIN, OFFICE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook_bytes(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """A workbook of sheets (name, rows of cells); cells that are plain numbers are written as such, others as shared strings."""
    shared: dict[str, int] = {}

    def cell(text: str) -> str:
        if re.fullmatch(r"-?(0|[1-9]\d{0,14})(\.\d+)?", text) and not re.fullmatch(r"-?\d+\.0|-0", text):
            return f"<c><v>{text}</v></c>"
        return f'<c t="s"><v>{shared.setdefault(text, len(shared))}</v></c>' if text else "<c/>"

    parts = {f"xl/worksheets/sheet{k}.xml": f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>" for k, (_, rows) in enumerate(sheets, 1)}
    parts["xl/workbook.xml"] = f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{_escaped(n)}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">' + "".join(f'<si><t xml:space="preserve">{_escaped(t)}</t></si>' for t in shared) + "</sst>"
    return _zipped(parts)


def document_bytes(elements: list[tuple[str, str]]) -> bytes:
    """A word-processor file of (kind, text): headings and paragraphs."""
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    style = lambda kind: '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if kind == "heading" else ""
    body = "".join(f'<w:p>{style(k)}<w:r><w:t xml:space="preserve">{_escaped(t)}</w:t></w:r></w:p>' for k, t in elements)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>'})
