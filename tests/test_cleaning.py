import pytest
from pyspark.sql import functions as F

from strandline.functions import cleaning
from strandline.functions.text import body_rows, count_tokens, display_number, embed_text, header_md, norm, table_markdown

CASES = [
    ("a 【 58†L23-L31 】 b", "a b", {"citation_markers": 1, "repeated_spaces": 1}),
    ("x 【 1 L314 】 y", "x y", {"citation_markers": 1, "repeated_spaces": 1}),
    ("【重要な文書】", "【重要な文書】", {}),
    ("∗ †", "∗ †", {}),
    ("inges-\ntion", "ingestion", {"hyphen_line_breaks": 1}),
    ("state-\nOf-the-art", "state-\nOf-the-art", {}),
    ("ingestion , Docling is  best .", "ingestion, Docling is best.", {"space_before_punctuation": 2, "repeated_spaces": 1}),
    ("half 【 open", "half open", {"orphaned_citation_brackets": 1}),
    ("ﬁne", "fine", {"unicode_normalised": 1}),
    ("one ..... 9", "one 9", {"dot_leaders": 1, "repeated_spaces": 1}),
    ("a\n\n\n\n\nb •", "a\n\nb", {"repeated_blank_lines": 1, "trailing_bullets": 1}),
    ("zero\u200bwidth", "zerowidth", {"invisible_chars": 1}),
    ("( a )", "(a)", {"space_after_bracket": 1, "space_before_punctuation": 1}),
    ("", "", {}),
    (None, None, {}),
]


def test_rules(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "doc_id int, text string")
    for r in cleaning.clean(rows).collect():
        assert (r.text, r.fixes or {}) == (CASES[r.doc_id][1], CASES[r.doc_id][2]), CASES[r.doc_id][0]


def test_code_keeps_its_spacing(spark):
    rows = spark.createDataFrame([("code", "if  x :\n    y"), ("paragraph", "if  x :\n    y")], "kind string, text string")
    got = {r.kind: r.text for r in cleaning.clean(rows, verbatim=F.col("kind") == "code").collect()}
    assert got["code"] == "if  x :\n    y" and got["paragraph"] == "if x:\n y"


def test_report_and_cells(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "doc_id int, text string")
    report = {r.rule: r.fixes for r in cleaning.report(cleaning.clean(rows)).collect()}
    assert report["citation_markers"] == 2 and report["repeated_spaces"] == 4
    grid = spark.createDataFrame([([["ab", " long cell  "], ["x【 1†L2 】y", "12"]],)], "g array<array<string>>")
    assert grid.select(cleaning.clean_cells(F.col("g"))).first()[0] == [["ab", "long cell"], ["xy", "12"]]


def test_renderings(spark):
    df = spark.createDataFrame([(["h", "i"], [["h", "i"], ["1", "2"]])], "h array<string>, g array<array<string>>")
    r = df.select(header_md(F.col("h")), table_markdown(F.col("g")), body_rows(F.col("g"), F.col("h")), header_md(F.array().cast("array<string>"))).first()
    assert r[0] == "| h | i |\n|---|---|" and r[1] == "| h | i |\n|---|---|\n| 1 | 2 |" and r[2] == [["1", "2"]] and r[3] == ""
    df = spark.createDataFrame([(["A", "B"], "", "before", "text", None)], "p array<string>, s string, l string, c string, t string")
    got = df.select(embed_text(F.col("p"), F.col("s"), F.col("l"), F.col("c"), F.col("t"))).first()[0]
    assert got == "A > B\n\n[before] before\n\ntext"


@pytest.mark.parametrize("text, n", [("one two", 2), ("1234", 2), ("a-b!", 4), ("", 0), (None, 0), ("über 漢字", 2)])
def test_tokens(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(count_tokens(F.col("t"))).first()[0] == n


def test_numbers_and_norm(spark):
    df = spark.createDataFrame([(1234.0, False), (1234.5, False), (2.0, True), (None, True)], "v double, d boolean")
    assert [r[0] for r in df.select(display_number(F.col("v"), F.col("d"))).collect()] == ["1,234", "1,234.50", "2.00", "?"]
    assert spark.range(1).select(norm(F.lit("  A—b  C3 "))).first()[0] == "a b c3"
