from pyspark.sql import functions as F

from strandline.plans import driver

ELEMENT = "doc_id string, pos int, kind string, text string, n_tokens int, level int, page int, t0 double, t1 double, speaker string, caption_ids array<string>, el_id string, grid array<array<string>>, header_row array<string>"


def element(doc, pos, kind, text="", **more):
    row = {"doc_id": doc, "pos": pos, "kind": kind, "text": text, "n_tokens": len(text.split()), "el_id": f"{doc}{pos}"} | more
    return tuple(row.get(c.split()[0]) for c in ELEMENT.split(", "))


def units(spark, rows, **options):
    found = driver.chunk(spark.createDataFrame(rows, ELEMENT), **options)
    return {k: [r for r in sorted(found.collect(), key=lambda r: r.unit_id) if r.doc_id == k] for k in {r[0] for r in rows}}


def test_all_routes(spark):
    prose = "Words of a paragraph that stand here for quite a while now."
    rows = [element("s", 0, "heading", "Paper", level=1)]
    for k in range(1, 4):
        rows += [element("s", 10 * k, "heading", f"{k} Part"), element("s", 10 * k + 1, "paragraph", f"{prose} See Table 1."), element("s", 10 * k + 2, "paragraph", prose)]
    rows += [element("s", 40, "caption", "Table 1: sums"), element("s", 41, "table", "| a | b |\\n| 1 | 2 |", caption_ids=["s40"]), element("s", 42, "figure", page=7)]
    rows += [element("f", k, "paragraph", f"{prose} " * 20) for k in range(6)]
    rows += [element("t", 0, "speech_segment", "Shall we?", t0=0.0, t1=9.0, speaker="A"), element("t", 1, "speech_segment", "Yes.", t0=9.2, t1=11.0, speaker="B"), element("t", 2, "speech_segment", "We agreed on it.", t0=11.1, t1=20.0, speaker="B")]
    rows += [element("v", 0, "visual_event", "a slide", t0=0.0, t1=15.0), element("v", 1, "speech_segment", "this is it", t0=1.0, t1=7.0, speaker="A")]
    grid = [["h", "i"], *[[str(k), "cell of some words " * 3] for k in range(200)]]
    rows += [element("x", 0, "table", "| h | i |" + " cell" * 900, grid=grid, header_row=["h", "i"])]
    got = units(spark, rows)

    assert {k: {u.route for u in v} for k, v in got.items()} == {"s": {"structural"}, "f": {"paragraph_fallback"}, "t": {"temporal"}, "v": {"temporal"}, "x": {"tabular"}}
    sections = [u for u in got["s"] if u.strategy == "structural"]
    assert [u.heading_path for u in sections][1:] == [["1 Part"], ["2 Part"], ["3 Part"]]
    table, figure = got["s"][-2:]
    assert table.content.startswith("Table 1: sums") and table.members == [41, 40] and table.flags == [] and figure.flags == ["uncaptioned figure"] and "page 7" in figure.content
    assert all(u.references == [table.unit_id] for u in sections[1:]) and [u.next_id for u in got["s"]] == [*range(1, len(got["s"])), None]
    assert len(got["f"]) > 1 and all(u.n_tokens <= 700 and not u.overflow and "orphan" in u.flags for u in got["f"])
    assert [(u.speaker, u.start_s, u.end_s, u.unit_type) for u in got["t"]] == [("A", 0.0, 9.0, "speaker_turn"), ("B", 9.2, 20.0, "decision")]
    assert len(got["v"]) == 1 and got["v"][0].unit_type == "video_event"
    assert got["x"][0].unit_type == "schema_card" and "200 rows × 2 columns" in got["x"][0].content and len(got["x"]) > 2
    assert all(u.content.startswith("| h | i |") for u in got["x"][1:])
    every = {(k, p) for k, v in got.items() for u in v for p in u.members}
    assert every == {(r[0], r[1]) for r in rows}
    assert all(u.reason and u.completeness is not None and u.strategy for v in got.values() for u in v)


def test_elements_are_cleaned_first(spark):
    rows = [element("d", 0, "paragraph", "inges-\ntion , Docling is  best ."), element("d", 1, "paragraph", "\u200b"), element("d", 2, "code", "x  = 1"), element("d", 3, "figure")]
    got = units(spark, rows)["d"]
    assert got[0].content == "ingestion, Docling is best.\n\nx  = 1" and got[0].members == [0, 2]
    assert units(spark, rows, clean=False)["d"][0].members == [0, 1, 2]


def test_empty_table(spark):
    assert driver.chunk(spark.createDataFrame([], ELEMENT)).count() == 0


def test_no_element_is_lost(spark, small):
    from strandline.plans import catalogue

    elements = catalogue._hosts(spark, small)
    members = driver.chunk(elements, clean=False).select("doc_id", F.explode("members").alias("pos"))
    assert members.count() == elements.count() == members.distinct().count()


def test_settings_act(spark):
    rows = [element("f", k, "paragraph", "Words of a paragraph that stand here for a while now. " * 10) for k in range(8)]
    whole = units(spark, rows, clean=False)["f"]
    try:
        spark.conf.set("strandline.max_chunk_tokens", "250")
        spark.conf.set("strandline.target_chunk_tokens", "200")
        small = units(spark, rows, clean=False)["f"]
    finally:
        spark.conf.unset("strandline.max_chunk_tokens")
        spark.conf.unset("strandline.target_chunk_tokens")
    assert len(small) > len(whole) and max(u.n_tokens for u in small) <= 250 < max(u.n_tokens for u in whole)


def test_cards_show_types_and_values(spark):
    grid = [["id", "kind", "price", "note"], *[[f"k{k}", "red" if k % 2 else "blue", f"{k}.50", "" if k else "only"] for k in range(40)]]
    rows = [element("x", 0, "table", "| h |" + " cell" * 900, grid=grid, header_row=grid[0])]
    card = units(spark, rows, clean=False)["x"][0].content
    assert card == "Dataset: x\n40 rows × 4 columns\n\nColumns:\n  - id (identifier): 40 unique values, e.g. 'k0'\n  - kind (categorical): blue, red\n  - price (decimal): 0.50 … 39.50, mean 20.00\n  - note (categorical, 39 empty): only"
