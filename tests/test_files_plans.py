import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import quality
from strandline.plans import chunking
from strandline.settings import settings
from strandline.sources import files

MD = "# Title\n\nFirst line\nsecond line.\n\n- one\n- two\n\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n```py\nx  = 1\n```\n## Next\nend"
HTML = "<head><title>no</title></head><h1>T &amp; U</h1><p>one<p>two <b>bold</b></p><ul><li>x<li>y</ul><table><caption>C</caption><tr><th>h<th>i<tr><td>1<td>2</table><figure><img><figcaption>F</figcaption></figure><pre>a  b</pre><nav><p>menu</p></nav>"


def test_files_of_all_kinds(spark, tmp_path):
    for name, text in (("a.md", MD), ("b.html", HTML), ("c.csv", "h;i\n1;x\n2;y\n"), ("d.txt", "one\ntwo\n\nthree"), ("e.bin", "?")):
        (tmp_path / name).write_text(text)
    found = files.read_files(spark, f"file://{tmp_path}")
    assert {r.ext for r in found.collect()} == {"md", "html", "csv", "txt", "bin"} and files.unsupported(found).count() == 1
    got = {}
    for r in files.parse_files(found).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id[-4:].lstrip("/"), []).append((r.kind, r.text))
    assert got["a.md"] == [("heading", "Title"), ("paragraph", "First line second line."), ("list_item", "one"), ("list_item", "two"), ("table", "| a | b |\n|---|---|\n| 1 | 2 |"), ("code", "x  = 1"), ("heading", "Next"), ("paragraph", "end")]
    assert got["html"] == [("heading", "T & U"), ("paragraph", "one"), ("paragraph", "two bold"), ("list_item", "x"), ("list_item", "y"), ("caption", "C"), ("table", "| h | i |\n|---|---|\n| 1 | 2 |"), ("figure", ""), ("caption", "F"), ("code", "a  b")]
    assert got[".csv"] == [("table", "| h | i |\n|---|---|\n| 1 | x |\n| 2 | y |")] and got[".txt"] == [("paragraph", "one two"), ("paragraph", "three")]


def test_names_are_made_safe(spark):
    names = spark.createDataFrame([("../../etc/pass wd",), ("C:\\x\\y?.md",), ("...",)], "n string")
    assert [r[0] for r in names.select(files.safe_name(F.col("n"))).collect()] == ["pass wd", "y_.md", "file"]


def test_transcripts_and_scenes(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"start": 0, "end": 1, "text": " a ", "speaker": "S"}, {"start": 1, "end": 2, "text": " "}, {"start": 2, "end": 3, "text": "b"}]}))
    assert [(r.el_id, r.text) for r in files.read_transcripts(spark, f"file://{tmp_path}/t.json").orderBy("pos").collect()] == [("seg_0000", "a"), ("seg_0002", "b")]
    (tmp_path / "s.json").write_text(json.dumps({"scenes": [{"t0": 1, "t1": 4, "speech_text": "hi", "visual_event": "a slide", "ocr_text": "Q3"}, {"t0": 4, "visual_event": "end"}]}))
    got = files.read_scenes(spark, f"file://{tmp_path}/s.json").orderBy("pos").collect()
    assert [(r.kind, r.text, r.t1) for r in got] == [("speech_segment", "hi", 4.0), ("visual_event", "[Scene 1] a slide | On-screen Text: Q3", 4.0), ("visual_event", "[Scene 2] end", 9.0)]


def test_large_tables_are_split_between_rows(spark):
    rows = [["h", "i"], *[[str(k), "word " * 20] for k in range(60)]]
    df = spark.createDataFrame([("d", 0, rows, ["h", "i"], "Table 1"), ("d", 1, rows[:3], ["h", "i"], None)], "doc_id string, pos int, grid array<array<string>>, header_row array<string>, caption string")
    got = chunking.split_floats(df).orderBy("pos", "part").collect()
    big = [r for r in got if r.pos == 0]
    assert len(big) > 2 and all(r.content.startswith("Table 1\n\n| h | i |\n|---|---|\n") and r.n_tokens <= 520 for r in big)
    assert sum(r.content.count("\n| ") for r in big) - len(big) == 60 - len(big) + len(big)
    assert [(r.parts, r.caption_confidence) for r in got if r.pos == 1] == [(1, 0.0)]


def test_relations_of_units(spark):
    edges = spark.createDataFrame([("d", 0, 5, "references", 0.9), ("d", 1, 6, "references", 0.9), ("d", 1, 2, "references", 0.9), ("d", 0, 1, "next", 1.0)], "doc_id string, src int, dst int, type string, confidence double")
    members = spark.createDataFrame([("d", 0, 1), ("d", 1, 1), ("d", 2, 1), ("d", 5, 2), ("d", 6, 2), ("d", 6, 3)], "doc_id string, pos int, unit_id int")
    assert [(r.unit_id, r.target_id) for r in chunking.projected_relations(edges, members).collect()] == [(1, 2)]
    units = spark.createDataFrame([("d", 1, "c", "section", "structural", 3), ("d", 2, "e", "section", "structural", 3)], "doc_id string, unit_id int, content string, unit_type string, strategy string, n_tokens int")
    got = {r.id_: json.loads(r.relationships) for r in chunking.export_llamaindex(units, chunking.projected_relations(edges, members)).collect()}
    assert got == {"d:1": {"references": "2"}, "d:2": {}}
    assert chunking.export_qdrant(units).count() == 2 and json.loads(chunking.vector_rows(units).first().payload)["doc_id"] == "d"


def test_scorecard(spark):
    probes = spark.createDataFrame([("d", 1, "caption", "row a", "table 1"), ("d", 2, "header", "row", "h i"), ("d", 3, "heading", "row b", "intro"), ("d", 4, "heading", "none", "x")], "doc_id string, probe_id int, metric string, bearing string, wanted string")
    chunks = spark.createDataFrame([("d", "table 1 h i row a", None), ("d", "row b", "intro")], "doc_id string, chunk string, context string")
    scores = quality.containment(probes, chunks)
    assert {r.metric: (r.hits, r.total) for r in scores.collect()} == {"caption": (1, 1), "header": (0, 1), "heading": (1, 2)}
    assert quality.preservation_score(scores).first().score == 50.0 and quality.preservation_score(scores.filter("false")).first().score is None


def test_settings(spark):
    assert settings(spark).max_chunk_tokens == 700
    for key, value in (("max_chunk_tokens", "5"), ("llm", "other"), ("weight_graph", "x")):
        spark.conf.set(f"strandline.{key}", value)
        with pytest.raises(ValueError, match=key):
            settings(spark)
        spark.conf.unset(f"strandline.{key}")


def test_table_probes(spark):
    grid = [["name of it", "amount"], ["the first of the rows", "12"], ["x", "1"], ["the second of the rows", "13"]]
    rows = [("d", 0, "caption", "Table 1: Sums", None, None), ("d", 1, "table", "", grid, grid[0]), ("d", 2, "table", "", [["only head"]], ["only head"])]
    elements = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string, grid array<array<string>>, header_row array<string>")
    captions = spark.createDataFrame([("d", 0, 1, "captions")], "doc_id string, src int, dst int, type string")
    probes = quality.table_probes(elements, captions)
    assert {(r.probe_id, r.metric, r.bearing, r.wanted) for r in probes.collect()} == {(1, "caption", "the first of the rows 12", "table 1 sums"), (1, "header", "the first of the rows 12", "name of it amount"), (1, "header", "the second of the rows 13", "name of it amount")}
    chunks = spark.createDataFrame([("d", "table 1 sums name of it amount the first of the rows 12", None), ("d", "the second of the rows 13", None)], "doc_id string, chunk string, context string")
    assert {r.metric: r.hits for r in quality.containment(probes, chunks).collect()} == {"caption": 1, "header": 0}
