import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import boundary, retrieval, usage, vectors, video
from strandline.plans import driver
from strandline.sources import files, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks_come_back():
    draw = random.Random(1)
    signs = ["", "x", "a & <b>", "12", "-7.25", "007", "1.0", "é中", " pad ", "1e5", "=A1", "TRUE"]
    for _ in range(30):
        sheets = [(f"S&{k}", [[draw.choice(signs) for _ in range(3)] for _ in range(draw.randrange(6))]) for k in range(draw.randrange(1, 4))]
        got = list(office.workbook_sheets(office.workbook_bytes(sheets)))
        assert [(p, n) for p, n, _ in got] == [(k + 1, n) for k, (n, _) in enumerate(sheets)]
        for (_, rows), (_, _, back) in zip(sheets, got):
            want = [[c.strip() for c in r] for r in rows if any(c.strip() for c in r)]
            width = max((max((k + 1 for k, c in enumerate(r) if c), default=0) for r in want), default=0)
            assert [r[:width] for r in back] == [r[:width] for r in want]


def test_styles_kinds_and_places_of_cells():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    row = '<row><c r="A1" t="inlineStr"><is><t>d</t></is></c><c r="C1" s="1"><v>45292</v></c><c r="D1" s="2"><v>0.5</v></c><c r="E1" s="3"><v>45292.25</v></c><c r="AA1" t="b"><v>1</v></c></row>'
    parts = {
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="One" r:id="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x" Target="/xl/s.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="20"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/s.xml": f"<worksheet {main}><sheetData>{row}<row/></sheetData></worksheet>",
    }
    ((page, name, rows),) = office.workbook_sheets(zipped(parts))
    assert (page, name) == (1, "One") and rows == [["d", "", "2024-01-01", "12:00:00", "2024-01-01 06:00:00", *[""] * 21, "TRUE"]]


def test_word_files_and_slides():
    body = "".join([
        '<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p>', "<w:p><w:r><w:t>one</w:t><w:br/><w:t>two</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p>",
        '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p>', '<w:p><w:pPr><w:pStyle w:val="Caption"/></w:pPr><w:r><w:t>Table 1</w:t></w:r></w:p>',
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>note</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    ])
    styles = f'<w:styles {W}><w:style w:styleId="H"><w:name w:val="heading 2"/></w:style></w:styles>'
    got = office.document_elements(zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles}))
    assert got == [("heading", "Top", 2, None, None), ("paragraph", "one\ntwo", None, None, None), ("list_item", "item", None, None, None), ("caption", "Table 1", None, None, None), ("table", "", None, [["note"], ["h"]], ["h"])]
    a, r = 'xmlns:a="x" xmlns:p="y"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    slide = f'<p:sld {a}><p:sp><p:ph type="title"/><a:p><a:r><a:t>T</a:t></a:r></a:p></p:sp><p:sp><a:p><a:t>b</a:t></a:p><a:p/></p:sp></p:sld>'
    deck = {"ppt/presentation.xml": f'<p:x {a} {r}><p:sldId r:id="i"/></p:x>', "ppt/_rels/presentation.xml.rels": '<R><Relationship Id="i" Target="slides/s.xml"/></R>', "ppt/slides/s.xml": slide}
    assert office.slide_elements(zipped(deck)) == [("heading", "T", 1, None, None, 1), ("list_item", "b", None, None, None, 1)]


def test_damaged_files_are_rows(spark):
    good = office.document_bytes([("heading", "Head"), ("paragraph", "Some text here."), ("paragraph", "")])
    rows = [("a", "docx", good), ("b", "docx", good[:100]), ("c", "docx", b"x"), ("d", "docx", zipped({"q": "x"})), ("e", "docx", zipped({"word/document.xml": "<a><b>"})), ("f", "xlsx", None), ("g", "md", b"# T\n\ntext"), ("h", "bin", b"")]
    parsed = files.parse_checked(spark.createDataFrame(rows, "doc_id string, ext string, content binary"))
    assert {r.doc_id: r.reason for r in files.failures(parsed).collect()} == {"b": "the archive is cut off", "c": "not an archive", "d": "no word/document.xml in the archive", "e": "word/document.xml is damaged: ParseError", "f": "not an archive"}
    good_rows = files.parse_files(spark.createDataFrame(rows, "doc_id string, ext string, content binary"))
    assert sorted((r.doc_id, r.pos, r.kind, r.text) for r in good_rows.collect()) == [("a", 0, "heading", "Head"), ("a", 1, "paragraph", "Some text here."), ("g", 0, "heading", "T"), ("g", 1, "paragraph", "text")]
    with pytest.raises(ValueError, match="every input failed: b: the archive is cut off; c: not"):
        files.failures(parsed.filter("doc_id in ('b', 'c')"))


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "One word, one WORD"), (2, "one word one word"), (3, "other things"), (4, None), (5, " .,")], "doc_id int, text string")
    got = {r.doc_id: r.embedding for r in vectors.embed(rows).collect()}
    assert got[1] == got[2] and got[4] is None and got[5] is None
    assert np.linalg.norm(got[1]) == pytest.approx(1) and np.linalg.norm(got[3]) == pytest.approx(1) and len(got[3]) == vectors.DIMS


def test_index_finds_what_is_near(spark, tmp_path):
    draw = np.random.default_rng(2)
    hearts = draw.normal(size=(12, 16))
    x = hearts[draw.integers(0, 12, 600)] + 0.3 * draw.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None)], "k long, v array<double>")
    index = vectors.CellIndex.build(rows, f"file://{tmp_path}/cells", "k", "v", cells=12)
    wanted = rows.filter("k % 20 = 0 and v is not null")
    exact = retrieval.top_k_each(wanted.select(F.col("k").alias("query_id"), "v"), rows.filter("v is not null"), "k", "v", k=10).select("query_id", F.col("k").alias("id"))
    found = vectors.recall(index.search(wanted, "k", "v"), exact).collect()[0]
    assert found.queries == 30 and found.recall >= 0.9 and index.probes < 12
    assert vectors.recall(index.search(wanted, "k", "v", probes=12), exact).collect()[0].recall == 1.0
    assert index.spark.read.parquet(index.path).count() == 600
    empty = vectors.CellIndex.build(rows.filter("v is null"), f"file://{tmp_path}/none", "k", "v", cells=3)
    assert empty.search(wanted, "k", "v").collect() == []


def test_flat_prose_is_cut_where_its_subject_changes(spark):
    about = {"a": "ships sail on the wide sea with the wind", "b": "bakers bake bread in hot ovens at dawn"}
    lines = [(1, k, "paragraph", f"{about['a' if k < 6 else 'b']} number {k % 2}", 12) for k in range(12)] + [(2, 0, "paragraph", "one line only", 3)]
    units = driver.chunk(vectors.embed(spark.createDataFrame(lines, "doc_id int, pos int, kind string, text string, n_tokens int"))).orderBy("doc_id", "unit_id").collect()
    assert [(u.doc_id, u.strategy, u.route, list(u.members)) for u in units] == [(1, "semantic", "semantic", list(range(6))), (1, "semantic", "semantic", list(range(6, 12))), (2, "paragraph_fallback", "semantic", [0])]


def test_consensus_counts_one_visual_sign_and_gaps(spark):
    rows = [(1, 0, "speech_segment", "a", 1, 0.0, 1.0, "A", "x"), (1, 1, "visual_event", "b", 1, 9.0, 10.0, "A", "y"), (1, 2, "visual_event", "c", 1, 10.0, 11.0, "A", "z"), (1, 3, "speech_segment", "why?", 1, 11.0, 12.0, "B", "z"), (1, 4, "speech_segment", "e", 1, 12.0, 13.0, "A", "z")]
    els = spark.createDataFrame(rows, "doc_id int, pos int, kind string, text string, n_tokens int, t0 double, t1 double, speaker string, visual_summary string")
    edges = spark.createDataFrame([], "doc_id int, src int, dst int, type string, confidence double, importance double")
    got = {r.pos: (round(r.multimodal_consensus, 6), r.qa_transition) for r in boundary.candidates(els.withColumn("region", F.lit(0)), edges, ["region"]).collect()}
    # a gap, a pause and a visual sign; a visual sign alone, though of two kinds; a speaker alone; a speaker after a question
    assert got == {1: (1.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.9)}


def test_windows_know_their_ends_and_merge_what_they_carry(spark):
    els = spark.createDataFrame([(1, k, k // 2, {"last": str(k), f"k{k}": "v"}, ["", "s", "t", "s"][k]) for k in range(4)] + [(2, 0, 0, {}, None)], "doc_id int, pos int, window int, meta map<string,string>, visual_summary string")
    zero = {s: 0.0 for s in video.SIGNALS}
    scored = spark.createDataFrame([{"doc_id": 1, "pos": 2, "score": 1.0, **zero, "speaker_change": 1.0, "temporal_gap": 0.3, "qa_transition": 0.9}, {"doc_id": 1, "pos": 1, "score": 9.0, **zero, "ocr_change": 1.0}])
    got = {(r.doc_id, r.window): (r.start_confidence, r.end_confidence, r.signals) for r in video.window_metadata(els, scored).collect()}
    assert got == {(1, 0): (0.0, 0.65, ["speaker_change", "qa_transition"]), (1, 1): (0.65, 0.0, ["speaker_change", "qa_transition"]), (2, 0): (0.0, 0.0, [])}
    merged = {(r.doc_id, r.window): (r.meta, r.visual_summary) for r in video.merged_meta(els, ["doc_id", "window"]).collect()}
    assert merged == {(1, 0): ({"k0": "v", "k1": "v", "last": "1"}, "s"), (1, 1): ({"k2": "v", "k3": "v", "last": "3"}, "t · s"), (2, 0): ({}, None)}


def test_reports_are_merged(spark):
    rows = spark.createDataFrame([(0, 3, 1, 1, 2, 0, "a"), (1, 4, 2, 1, 3, None, "b")], "number int, flagged int, enriched int, api_calls int, calls_saved_by_batching int, failed_calls int, provider string")
    assert tuple(usage.merge_reports(rows).collect()[0]) == (7, 3, 2, 5, 0, "b")
