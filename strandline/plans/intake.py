"""Files of many kinds, good and damaged ones: the queries over whole tables, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import usage
from strandline.plans import catalogue
from strandline.sources import elements as sources
from strandline.sources import files, office
from strandline.sources.elements import page_blocks
from strandline.stored import stored

ROWS_A_BOOK = 500


def _books(spark, d):
    """The customers of each nation as workbooks of at most ROWS_A_BOOK rows: a sheet about it, and the rows after a header."""
    customer = spark.read.parquet(f"{d}/customer.parquet")
    rows = sources.cells_of(customer, "c_nationkey", ["c_custkey"]).withColumn("book", F.floor(F.col("row_no") / ROWS_A_BOOK))
    header = customer.columns

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_no")
        nation, book = pdf["sheet"].iloc[0], pdf["book"].iloc[0]
        sheets = [("About", [["nation", str(nation)], ["part", str(book)]]), (f"Nation {nation}", [header, *([*c] for c in pdf["cells"])])]
        return pd.DataFrame({"doc_id": [f"nation-{nation}-{book}.xlsx"], "ext": ["xlsx"], "content": [office.workbook_bytes(sheets)]})

    return rows.groupBy("sheet", "book").applyInPandas(made, "doc_id string, ext string, content binary")


def workbooks_customer(spark, d):
    """The customers as sheets of workbooks, read back: the cells by their labelled sheets."""
    tables = files.parse_files(stored(_books(spark, d))).filter("sheet != 'About'")
    rows = tables.select("doc_id", "page", "sheet", F.posexplode(F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(1)))).alias("row", "cells"))
    names = [f"c{k}" for k in range(5)]
    return rows.select("doc_id", F.col("page").cast("long").alias("page"), "sheet", F.col("row").cast("long").alias("row"), *[F.col("cells")[k].alias(n) for k, n in enumerate(names)])


DAMAGE = ("cut", "other", "empty")


def _page_files(spark, d):
    """Pages as word-processor files; some of them damaged in three ways."""
    found = spark.read.parquet(f"{d}/pages.parquet")
    rows = found.select("page_id", page_blocks("html").alias("parts"))
    damage = F.when(F.col("page_id") % 7 == 3, "cut").when(F.col("page_id") % 11 == 5, "other").when(F.col("page_id") % 13 == 4, "empty")
    rows = rows.withColumn("damage", F.coalesce(damage, F.lit("")))

    def made(frames):
        for pdf in frames:
            out = []
            for page, parts, damage in zip(pdf["page_id"], pdf["parts"], pdf["damage"]):
                content = office.document_bytes([(p["kind"], p["text"]) for p in parts])
                content = {"cut": content[: len(content) // 2], "other": b"<html>", "empty": office._zipped({"other.xml": "<a/>"})}.get(damage, content)
                out.append((f"page-{page}.docx", "docx", content))
            yield pd.DataFrame(out, columns=["doc_id", "ext", "content"])

    return rows.mapInPandas(made, "doc_id string, ext string, content binary")


def damaged_beside_pages(spark, d):
    """What comes of good files among damaged ones: files and elements for each reason, none for those that are read."""
    parsed = stored(files.parse_checked(_page_files(spark, d)))
    bad = files.failures(parsed).groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.lit(0).cast("long").alias("elements"))
    good = parsed.filter("error is null").agg(F.lit("").alias("reason"), F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("elements"))
    return good.union(bad)


def enrichment_totals(spark, d):
    """The reports of hosts' enrichment as one; replies are made up as in enrichment_applied."""
    units = catalogue._section_units(spark, d).filter("unit_type = 'section'").select("doc_id", "unit_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_id")) - 1
    reports = units.withColumn("batch", F.floor(number / 6)).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("unit_id") % 4 != 0).alias("summed"))
    failed = F.col("batch") % 5 == 4
    reports = reports.groupBy("doc_id").agg(F.sum("units").alias("flagged"), F.sum(F.when(failed, 0).otherwise(F.col("summed"))).alias("enriched"), F.count(F.lit(1)).alias("api_calls"), (F.sum("units") - F.count(F.lit(1))).alias("calls_saved_by_batching"), F.count_if(failed).alias("failed_calls"), F.lit("ollama/small").alias("provider"))
    return usage.merge_reports(reports.withColumn("number", F.hash("doc_id").cast("long")))


def queries() -> dict:
    return {f.__name__: f for f in (workbooks_customer, damaged_beside_pages, enrichment_totals)}


def oracle_sql() -> dict[str, str]:
    from strandline.plans.oracle import HOSTS

    return {
        "workbooks_customer": f"""
            WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS no FROM customer)
            SELECT 'nation-' || c_nationkey || '-' || (no // {ROWS_A_BOOK}) || '.xlsx' AS doc_id, 2::BIGINT AS page, 'Nation ' || c_nationkey AS sheet, no % {ROWS_A_BOOK} AS row,
              c_custkey::VARCHAR AS c0, c_name AS c1, c_nationkey::VARCHAR AS c2, printf('%.2f', c_acctbal) AS c3, c_mktsegment AS c4 FROM r""",
        "damaged_beside_pages": f"""
            WITH {HOSTS}, k AS (SELECT page_id, CASE WHEN page_id % 7 = 3 THEN 'the archive is cut off' WHEN page_id % 11 = 5 THEN 'not an archive' WHEN page_id % 13 = 4 THEN 'no word/document.xml in the archive' ELSE '' END AS reason FROM pages),
            n AS (SELECT page_id, count(*) AS n FROM t WHERE text <> '' GROUP BY page_id)
            SELECT reason, count(*) AS files, coalesce(sum(n) FILTER (reason = ''), 0)::BIGINT AS elements FROM k LEFT JOIN n USING (page_id) WHERE reason <> '' OR n IS NOT NULL GROUP BY reason""",
        "enrichment_totals": f"""
            WITH {HOSTS}, b AS (SELECT doc_id, unit_id, (row_number() OVER (PARTITION BY doc_id ORDER BY unit_id) - 1) // 6 AS batch FROM units WHERE unit_type = 'section'),
            g AS (SELECT doc_id, batch, count(*) AS n, count(*) FILTER (unit_id % 4 <> 0) AS s FROM b GROUP BY ALL)
            SELECT sum(n)::BIGINT AS flagged, coalesce(sum(s) FILTER (batch % 5 <> 4), 0)::BIGINT AS enriched, count(*) AS api_calls, (sum(n) - count(*))::BIGINT AS calls_saved_by_batching, count(*) FILTER (batch % 5 = 4) AS failed_calls, 'ollama/small' AS provider FROM g""",
    }
