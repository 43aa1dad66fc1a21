import datetime as dt
import json

import pytest

from strandline.sources import elements as sources
from strandline.sources.elements import read_contract, read_contract_units
from strandline.streaming.transcripts import SEGMENT, live_turns, read_segments, write_turns


def contract(tmp_path, **fields):
    own = {"contract": 1, "source_uri": "v.mp4", "title": "V", **fields}
    (tmp_path / "my_meeting_record.json").write_text(json.dumps(own))
    return f"file://{tmp_path}"


def test_contract_elements(spark, tmp_path):
    elements = [{"id": "s0", "kind": "speech_segment", "text": " hi ", "t0": 0.0, "t1": 4.2, "speaker": "P", "meta": {"visual_summary": "title slide", "caption_ids": ["s1"]}}, {"id": "s1", "kind": "odd", "text": "x", "parent_id": "s0"}]
    rows = read_contract(spark, contract(tmp_path, elements=elements)).orderBy("pos").collect()
    assert [(r.el_id, r.kind, r.text, r.parent_id) for r in rows] == [("my_meeting_r_s0", "speech_segment", "hi", None), ("my_meeting_r_s1", "other", "x", "my_meeting_r_s0")]
    assert rows[0].caption_ids == ["my_meeting_r_s1"] and rows[0].speaker == "P"


def test_contract_units_drop_unknown_relations(spark, tmp_path):
    units = [{"id": "u", "content": "some text", "relationships": [{"type": "next", "target_id": "v"}, {"type": "odd", "target_id": "v"}]}]
    (r,) = read_contract_units(spark, contract(tmp_path, units=units)).collect()
    assert [x.type for x in r.relationships] == ["next"] and (r.modality, r.n_tokens) == ("video", 2)


def test_other_versions_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="not a contract"):
        read_contract(spark, contract(tmp_path, contract=99, elements=[])).collect()


def test_live_turns(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("d", "A", at(0), "one"), ("d", "A", at(10), "two"), ("d", "A", at(100), "three"), ("d", "B", at(5), "b"), ("z", "C", at(9000), "end")]
    spark.createDataFrame(rows, SEGMENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    for k in range(2):
        turns = live_turns(read_segments(spark, f"{tmp_path}/in"))
        write_turns(turns, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
        spark.createDataFrame([("z", "C", at(20_000), "later")], SEGMENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {(r.doc_id, r.speaker, r.content) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {("d", "A", "one two"), ("d", "A", "three"), ("d", "B", "b")} <= got


def test_pages_give_all_their_blocks(spark):
    html = """<html><HEAD><title>not shown</title><script>var t="<p>no</p>";</script></HEAD><body class=x><header>menu</header><!-- <p>no</p> -->
<article><h1 id="a">Title <b>bold</b></h1><p class="lead">First<br>second<p>third</p><h2>Below</h2><ul><li class="i">one<li>two</ul>
<table><tr><td>cell</td><th>head</th></tr></table>after</article><script async>let u = 1</script><footer>end</footer></body></html>"""
    rows = [(1, "https://a.example/x", html), (2, "https://a.example/y", None), (3, "https://a.example/z", ""), (4, "https://b.example/", "no tags \x02 at all")]
    got = sources.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("doc_id", "pos").collect()
    assert [(r.kind, r.text.strip()) for r in got if r.doc_id == "a.example"] == [
        ("paragraph", "menu"), ("heading", "Title bold"), ("paragraph", "First"), ("paragraph", "second"), ("paragraph", "third"), ("heading", "Below"),
        ("list_item", "one"), ("list_item", "two"), ("paragraph", "cell"), ("paragraph", "head"), ("paragraph", "after"), ("paragraph", "end"),
    ]
    assert [r.text for r in got if r.doc_id == "b.example"] == ["no tags   at all"] and [r.pos for r in got if r.doc_id == "a.example"] == list(range(12))
