"""Elements from files of several kinds, by their extension: Markdown, text, HTML, CSV, office files, and JSON transcripts and scenes.

Files are read with Spark's binary source, so any store that Spark reads will do. A file is parsed by one task, as a
document; large tables are better read with Spark's own readers and ``elements.cells_of``.
"""

from __future__ import annotations

import csv
import html
import io
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import count_tokens, table_markdown
from strandline.sources import office

# Which extension is read how.
MARKDOWN, TEXT, MARKUP, TABLE = ("md", "markdown"), ("txt", "asciidoc", "adoc"), ("html", "htm"), ("csv", "tsv")
SHEETS, WORDS, SLIDES = ("xlsx", "xlsm"), ("docx",), ("pptx",)
PARSED = "doc_id string, pos int, kind string, text string, level int, grid array<array<string>>, header_row array<string>, page int, sheet string, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), ext, title (the name without it), sha256, n_bytes, content of each file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.col("path").alias("doc_id"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")


def safe_name(name):
    """A file name without folders and odd signs, at most 120 characters; ``file`` if nothing is left."""
    leaf = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^\p{L}\p{N}._ -]+", "_")
    cut = F.substring(F.regexp_replace(leaf, r"^[. ]+", ""), 1, 120)
    return F.when(cut == "", "file").otherwise(cut)


def parse_checked(files: DataFrame) -> DataFrame:
    """Elements of ``files`` (doc_id, ext, content) with their tokens, and a row with ``error``, the reason, for each file that can't be
    read; the others go on. Empty texts are left out but for tables and figures. Files of other kinds give nothing
    (``unsupported`` lists them). A sheet of a workbook is a table with its page and name."""

    def elements(ext: str, content: bytes):
        if ext in SHEETS:
            return [(*_grid_element(rows, rows[0] if rows else None), page, name) for page, name, rows in office.workbook_sheets(content)]
        if ext in WORDS:
            return office.document_elements(content)
        if ext in SLIDES:
            return office.slide_elements(content)
        return _PARSERS[ext](content.decode("utf-8", "replace").lstrip("\ufeff"))

    def parsed(frames):
        for pdf in frames:
            rows = []
            for doc_id, ext, content in zip(pdf["doc_id"], pdf["ext"], pdf["content"]):
                try:
                    found = [(*e, *[None] * (7 - len(e))) for e in elements(ext, bytes(content or b"")) if e[1] or e[0] in ("table", "figure")]
                    rows += [(doc_id, pos, *e, None) for pos, e in enumerate(found)]
                except Exception as e:
                    rows.append((doc_id, -1, "other", "", *[None] * 5, str(e) if type(e) is ValueError else f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "kind", "text", "level", "grid", "header_row", "page", "sheet", "error"])

    known = files.filter(F.col("ext").isin([*_PARSERS, *SHEETS, *WORDS, *SLIDES]))
    rows = known.select("doc_id", "ext", "content").mapInPandas(parsed, PARSED)
    rows = rows.withColumn("text", F.when((F.col("kind") == "table") & F.col("grid").isNotNull(), table_markdown(F.col("grid"))).otherwise(F.col("text")))
    return rows.withColumn("n_tokens", count_tokens(F.col("text")))


def parse_files(files: DataFrame) -> DataFrame:
    """The elements that ``parse_checked`` finds; files that can't be read are left out."""
    return parse_checked(files).filter("error is null").drop("error")


def failures(parsed: DataFrame, must_have_any: bool = True) -> DataFrame:
    """doc_id, reason of the files of ``parsed`` (by ``parse_checked``) that couldn't be read. If all of them failed, an error with the
    first reasons, unless that may be."""
    bad = parsed.filter("error is not null").select("doc_id", F.col("error").alias("reason"))
    if must_have_any and parsed.filter("error is null").isEmpty() and not bad.isEmpty():
        first = bad.orderBy("doc_id").limit(5).collect()
        raise ValueError("every input failed: " + "; ".join(f"{r.doc_id}: {r.reason}" for r in first))
    return bad


def unsupported(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("ext").isin([*_PARSERS, *SHEETS, *WORDS, *SLIDES, "json"])).select("doc_id", F.concat(F.lit("no source for ."), "ext").alias("warning"))


def _element(kind: str, text: str, level: int | None = None, grid=None, header=None) -> tuple:
    return kind, text.strip(), level, grid, header


def _grid_element(grid: list[list[str]], header: list[str] | None) -> tuple:
    return _element("table", "", None, [[c.strip() for c in r] for r in grid], [c.strip() for c in header] if header else None)


def markdown_elements(text: str) -> list[tuple]:
    """Headings, list items, fenced code, pipe tables, and paragraphs between blank lines."""
    out, para, lines, k = [], [], text.split("\n"), 0

    def flush():
        if para:
            out.append(_element("paragraph", " ".join(x.strip() for x in para)))
            para.clear()

    while k < len(lines):
        line = lines[k]
        if m := re.match(r"\s*(```|~~~)", line):
            flush()
            end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            out.append(("code", "\n".join(lines[k + 1 : end]), None, None, None))
            k = end
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            out.append(_element("heading", m[2], len(m[1])))
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            flush()
            out.append(_element("list_item", m[1]))
        elif line.lstrip().startswith("|"):
            flush()
            end = k
            while end < len(lines) and lines[end].lstrip().startswith("|"):
                end += 1
            rows = [[c for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))] for x in lines[k:end]]
            split = len(rows) > 1 and all(re.fullmatch(r"\s*:?-+:?\s*", c) for c in rows[1])
            grid = [rows[0], *rows[2:]] if split else rows
            out.append(_grid_element(grid, rows[0]))
            k = end - 1
        elif not line.strip():
            flush()
        else:
            para.append(line)
        k += 1
    flush()
    return out


def text_elements(text: str) -> list[tuple]:
    return [_element("paragraph", " ".join(p.split("\n"))) for p in re.split(r"\n\s*\n", text)]


def table_elements(text: str) -> list[tuple]:
    """A file of separated values as one table; its first row is the header. The sign that is most frequent separates."""
    mark = max(",;\t", key=text.count)
    grid = [r for r in csv.reader(io.StringIO(text), delimiter=mark) if any(c.strip() for c in r)]
    return [_grid_element(grid, grid[0])] if grid else []


_BLOCKS = re.compile(r"<(h[1-6]|p|li|pre|figcaption|table|figure)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h[1-6]|p|li|pre|table|figure|ul|ol|div|section|article)\b|\Z)", re.S | re.I)
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|head|nav|footer|aside|template)\b.*?</\1\s*>", re.S | re.I)
_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)(?=</tr|<tr\b|\Z)", re.S | re.I), re.compile(r"<(t[hd])\b[^>]*>(.*?)(?=</t[hd]|<t[hd]\b|\Z)", re.S | re.I)
_KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "figcaption": "caption", "caption": "caption"}


def _plain(part: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", part)).split())


def markup_elements(text: str) -> list[tuple]:
    """Headings, paragraphs, list items, preformatted code, captions, figures, and tables with the header that <th> marks."""
    out, body, at = [], _HIDDEN.sub(" ", text), 0
    while m := _BLOCKS.search(body, at):
        tag, at = m[1].lower(), m.end()
        if tag == "table":
            end = re.compile(r"</table\s*>", re.I).search(body, m.start())
            inner = body[m.start() : end.start() if end else len(body)]
            at = end.end() if end else len(body)
            if cap := re.search(r"<caption\b[^>]*>(.*?)</caption", inner, re.S | re.I):
                out.append(_element("caption", _plain(cap[1])))
            rows = [[(c[1].lower(), _plain(c[2])) for c in _CELL.finditer(r[1])] for r in _ROW.finditer(inner)]
            rows = [r for r in rows if r]
            if rows:
                head = next((r for r in rows if any(t == "th" for t, _ in r)), rows[0])
                out.append(_grid_element([[c for _, c in r] for r in rows], [c for _, c in head]))
        elif tag == "figure":
            out.append(_element("figure", ""))
            at = m.start(2)
        elif tag[0] == "h":
            out.append(_element("heading", _plain(m[2]), int(tag[1])))
        elif tag == "pre":
            out.append(("code", html.unescape(re.sub(r"<[^>]*>", "", m[2])), None, None, None))
        else:
            out.append(_element(_KINDS[tag], _plain(m[2])))
    return out


_PARSERS = {**dict.fromkeys(MARKDOWN, markdown_elements), **dict.fromkeys(TEXT, text_elements), **dict.fromkeys(MARKUP, markup_elements), **dict.fromkeys(TABLE, table_elements)}

TRANSCRIPT = "segments array<struct<start: double, end: double, text: string, speaker: string>>"
SCENES = "scenes array<struct<t0: double, t1: double, speaker: string, speech_text: string, visual_event: string, ocr_text: string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Speech segments of transcript files; blank ones are left out, the others keep their number as ``el_id``."""
    files = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path).withColumn("doc_id", F.col("_metadata.file_path"))
    rows = files.select("doc_id", F.posexplode("segments").alias("k", "s")).withColumn("text", F.trim("s.text")).filter("text != ''")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1
    return rows.select("doc_id", pos.alias("pos"), F.format_string("seg_%04d", "k").alias("el_id"), F.lit("speech_segment").alias("kind"), "text", F.col("s.start").alias("t0"), F.col("s.end").alias("t1"), "s.speaker", count_tokens(F.col("text")).alias("n_tokens"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Speech and visual events of scene files: what is said, and what is to be seen with the words on the screen."""
    files = spark.read.schema(SCENES).option("multiLine", True).json(path).withColumn("doc_id", F.col("_metadata.file_path"))
    rows = files.select("doc_id", F.posexplode("scenes").alias("k", "s"))
    t0 = F.coalesce("s.t0", F.lit(0.0))
    seen, words = F.trim(F.coalesce("s.visual_event", F.lit(""))), F.trim(F.coalesce("s.ocr_text", F.lit("")))
    shown = F.concat(F.format_string("[Scene %d] ", F.col("k") + 1), seen, F.when(words != "", F.concat(F.lit(" | On-screen Text: "), words)).otherwise(""))
    both = F.array(F.struct(F.lit("speech_segment").alias("kind"), F.trim(F.coalesce("s.speech_text", F.lit(""))).alias("text"), F.col("s.speaker").alias("speaker")), F.struct(F.lit("visual_event").alias("kind"), F.when(seen != "", shown).otherwise("").alias("text"), F.lit(None).cast("string").alias("speaker")))
    rows = rows.select("doc_id", "k", t0.alias("t0"), F.coalesce("s.t1", t0 + 5).alias("t1"), words.alias("ocr_text"), F.posexplode(both).alias("side", "e")).filter("e.text != ''")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("k", "side")) - 1
    return rows.select("doc_id", pos.alias("pos"), "e.kind", "e.text", "e.speaker", "t0", "t1", "ocr_text", F.when(F.col("e.kind") == "visual_event", F.col("e.text")).alias("visual_summary"), count_tokens(F.col("e.text")).alias("n_tokens"))
