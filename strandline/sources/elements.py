"""The element table: doc_id, pos, kind, text, n_tokens and what a source knows besides, ordered by pos in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import count_tokens

# The kinds of elements; another kind becomes ``other``.
KINDS = ["heading", "paragraph", "list_item", "table", "figure", "caption", "code", "speech_segment", "visual_event", "other"]

CONTRACT = """contract INT, source_uri STRING, title STRING, elements ARRAY<STRUCT<id: STRING, kind: STRING, text: STRING,
level: INT, parent_id: STRING, page: INT, bbox: ARRAY<DOUBLE>, t0: DOUBLE, t1: DOUBLE, speaker: STRING,
meta: STRUCT<visual_summary: STRING, visual_change_type: STRING, ocr_text: STRING, entities: ARRAY<STRING>,
grid: ARRAY<ARRAY<STRING>>, header_row: ARRAY<STRING>, caption_ids: ARRAY<STRING>, sheet: STRING>>>,
units ARRAY<STRUCT<id: STRING, content: STRING, modality: STRING, token_count: INT,
relationships: ARRAY<STRUCT<type: STRING, target_id: STRING, confidence: DOUBLE, evidence: STRING>>>>"""

# The types of relationships between units.
RELATIONS = ["captions", "captioned_by", "parent", "parent_of", "child_of", "references", "explains", "illustrated_by", "has_schema", "schema_of", "answered_by", "question_for", "occurs_during", "occurs_in_scene", "slide_content_of", "spoken_by", "next", "previous"]


def kind_of(kind):
    return F.when(kind.isin(KINDS), kind).otherwise("other")


def from_lines(docs: DataFrame) -> DataFrame:
    """Each line of a document's text as a paragraph."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.select("doc_id", "pos", F.lit("paragraph").alias("kind"), "text", count_tokens(F.col("text")).alias("n_tokens"))


#: What isn't shown of a page, and the tags that part its blocks; headings and list items are known by theirs.
UNSEEN = [r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?is)<head\b.*?</head\s*>"]
BLOCKS = "address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
MARK = "\x02"


def page_blocks(html: str):
    """All blocks of a whole page with text, as an array of (kind, text): headings, list items, and whatever else stands between two tags of
    BLOCKS as paragraphs. Tags may have attributes and need no end."""
    seen = F.replace(html, F.lit(MARK), F.lit(" "))
    for pattern in UNSEEN:
        seen = F.regexp_replace(seen, pattern, " ")
    for tag, kind in (("<h[1-6]", "H"), ("<li", "L"), (f"</?(?:{BLOCKS})", "P")):
        seen = F.regexp_replace(seen, rf"(?i){tag}(?:\s[^>]*)?/?>", MARK + kind)
    kind = lambda x: F.when(x.startswith("H"), "heading").when(x.startswith("L"), "list_item").otherwise("paragraph")
    text = lambda x: F.trim(F.regexp_replace(F.substring(x, 2, 2**31 - 1), "<[^>]*>", ""), F.lit(" \t\n\f\r"))
    parts = F.split(F.concat(F.lit(MARK + "P"), seen), MARK, -1)
    return F.filter(F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), text(x).alias("text"))), lambda x: x["text"] != "")


def from_pages(pages: DataFrame) -> DataFrame:
    """The blocks of whole pages, the pages of a host as one document in page order. A null page has none."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    rows = pages.select(host.alias("doc_id"), "page_id", F.posexplode(page_blocks("html")).alias("part", "e"))
    order = Window.partitionBy("doc_id").orderBy("page_id", "part")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("pos"), "e.kind", "e.text", count_tokens(F.col("e.text")).alias("n_tokens"))


def from_conversations(turns: DataFrame, chars_a_second: int = 15) -> DataFrame:
    """Turns as speech segments; the clock is in milliseconds, a turn lasting as long as its text takes to say."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    length = F.floor(F.length("text") * 1000 / chars_a_second)
    ends = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.select(F.col("conv_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("pos"), F.lit("speech_segment").alias("kind"), "text", F.col("role").alias("speaker"), (ends - length).alias("t0_ms"), ends.alias("t1_ms"))
    return rows.withColumn("n_tokens", count_tokens(F.col("text")))


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Contract files (version 1), one document each: elements with ids prefixed by the file's name.

    Another version raises an error, as does a file without elements or units.
    """
    files = spark.read.schema(CONTRACT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    right = (F.col("contract") == 1) & (F.col("elements").isNotNull() | F.col("units").isNotNull())
    files = files.withColumn("contract", F.when(right, F.col("contract")).otherwise(F.raise_error("not a contract of version 1 with elements or units")))
    stem = F.substring(F.regexp_replace("file", r"\.[^.]*$", ""), 1, 12)
    rows = files.filter("contract = 1").select(F.col("source_uri").alias("doc_id"), stem.alias("stem"), F.posexplode("elements").alias("pos", "e"))
    own = lambda c: F.concat("stem", F.lit("_"), c)
    return rows.select("doc_id", "pos", own(F.col("e.id")).alias("el_id"), kind_of(F.col("e.kind")).alias("kind"), F.trim("e.text").alias("text"), "e.level", own(F.col("e.parent_id")).alias("parent_id"), "e.page", "e.bbox", "e.t0", "e.t1", "e.speaker", F.transform("e.meta.caption_ids", own).alias("caption_ids"), "e.meta", count_tokens(F.trim("e.text")).alias("n_tokens"))


def read_contract_units(spark: SparkSession, path: str) -> DataFrame:
    """Finished units of contract files; relationships of unknown types are left out."""
    files = spark.read.schema(CONTRACT).option("multiLine", True).json(path).filter("contract = 1 and units is not null")
    rows = files.select(F.col("source_uri").alias("doc_id"), F.posexplode("units").alias("pos", "u"))
    known = F.filter("u.relationships", lambda r: r["type"].isin(RELATIONS))
    return rows.select("doc_id", "pos", F.col("u.id").alias("unit_id"), "u.content", F.coalesce("u.modality", F.lit("video")).alias("modality"), F.coalesce("u.token_count", count_tokens(F.col("u.content"))).alias("n_tokens"), known.alias("relationships"))


def cells_of(table: DataFrame, sheet: str, order: list[str]) -> DataFrame:
    """The rows of a table as text cells: sheet, row_no (from 0 in a sheet, by ``order``), cells."""
    place = F.row_number().over(Window.partitionBy(sheet).orderBy(*order)) - 1
    return table.select(F.col(sheet).alias("sheet"), place.alias("row_no"), F.array(*[as_text(n, k) for n, k in table.dtypes]).alias("cells"))


def as_text(name: str, kind: str):
    text = F.date_format(name, "yyyy-MM-dd") if kind.startswith("timestamp") else F.format_string("%.2f", name) if kind == "double" else F.col(name).cast("string")
    return F.when(F.col(name).isNull(), "").otherwise(text)
