import random

from pyspark.sql import functions as F

from strandline.operators import quality, retrieval, tables, turns, usage, video
from strandline.sources.elements import from_conversations

CELL = "name string, value string"


def types(spark, columns):
    cells = spark.createDataFrame([(n, v) for n, vs in columns.items() for v in vs], CELL)
    return {r.name: r for r in tables.profile_columns(cells).collect()}


def test_column_types(spark):
    got = types(spark, {
        "i": ["1", "2", "3", "40"], "d": ["4.9", "5", "6.1", "0.8"], "t": ["2024-01-02", "2024-02-03"], "c": ["North", "South"] * 2,
        "p": ["12%", "4.5%"], "k": [f"SO-{k}" for k in range(40)], "b": ["yes", "No"], "n": ["", "n/a", None], "x": ["10", "20", "30"],
        "s": ["1", "", "3", "n/a"], "w": [f"some prose that is rather long, number {k}, and goes on for over sixty signs" for k in range(3)] * 2,
    })
    assert {k: r.dtype for k, r in got.items()} == {"i": "integer", "d": "decimal", "t": "date", "c": "categorical", "p": "percentage", "k": "identifier", "b": "boolean", "n": "empty", "x": "integer", "s": "integer", "w": "text"}
    assert (got["x"].minimum, got["x"].maximum, got["x"].mean) == (10, 30, 20) and (got["s"].nulls, got["s"].non_null) == (2, 2)
    assert got["c"].distinct_values == 2 and got["n"].nulls == 3


def test_row_groups_keep_rows_whole(spark):
    draw = random.Random(3)
    rows = [("s", k, [str(k), "word " * draw.randint(1, 30)]) for k in range(200)]
    df = spark.createDataFrame(rows, "sheet string, row_no int, cells array<string>")
    groups = tables.row_groups(df, ["a", "b"], 200)
    got = {r.row_no: r.group for r in groups.collect()}
    cost = lambda cells: sum(len([t for t in ("| " + " | ".join(cells) + " |").split()]) for _ in [0])
    assert sorted(got) == list(range(200)) and max(got.values()) > 5
    assert all(got[k + 1] - got[k] in (0, 1) for k in range(199)) and cost(["a"]) == 3
    units = tables.group_units(df, ["a", "b"], groups).collect()
    assert sum(r.rows for r in units) == 200 and all(r.content.startswith("| a | b |\n|---|---|\n") for r in units)


SEGMENT = "doc_id string, pos int, text string, speaker string, t0 double, t1 double, n_tokens int"


def test_turns(spark):
    rows = [("d", 0, "a", "A", 0.0, 9.0, 1), ("d", 1, "b", "B", 9.2, 11.0, 1), ("e", 0, "a", "A", 0.0, 10.0, 1), ("e", 1, "b", "A", 10.2, 16.0, 1), ("f", 0, "a", "A", 0.0, 9.0, 1), ("f", 1, "b", None, 9.0, 10.0, 1)]
    runs = turns.absorb_short(turns.speaker_runs(spark.createDataFrame(rows, SEGMENT)))
    got = {(r.doc_id, r.turn): (r.content, r.speaker, r.start_s, r.end_s) for r in turns.turn_units(runs, ["turn"]).collect()}
    assert got == {("d", 0): ("a", "A", 0.0, 9.0), ("d", 1): ("b", "B", 9.2, 11.0), ("e", 0): ("a b", "A", 0.0, 16.0), ("f", 0): ("a b", "A", 0.0, 10.0)}


def test_long_turns_split_at_the_last_widest_gap(spark):
    t0 = [0, 30, 65, 100, 135]
    rows = [("d", k, "x", "A", float(t), float(t + 25), 1) for k, t in enumerate(t0)]
    df = spark.createDataFrame(rows, SEGMENT).withColumn("turn", F.lit(0))
    assert [r.part for r in turns.split_long(df).orderBy("pos").collect()] == [0, 0, 0, 1, 2]
    assert {r.part for r in turns.split_long(df, 1000.0).collect()} == {0}


def test_conversational_types(spark):
    said = {
        "q": [("A", "What is the plan?"), ("B", "We ship.")], "d": [("A", "So we agreed on that."), ("B", "Yes")], "a": [("A", "Action item: I will follow up")],
        "m": [("A", "one"), ("B", "two")], "s": [("A", "one"), ("A", "two?")], "n": [(None, "one")], "l": [("A", "one"), ("B", "two?")],
    }
    rows = [(k, i, t, s, 0.0, 1.0, 1) for k, v in said.items() for i, (s, t) in enumerate(v)]
    got = {r.doc_id: r.type for r in turns.conversational_type(spark.createDataFrame(rows, SEGMENT)).collect()}
    assert got == {"q": "question_answer", "d": "decision", "a": "action_item", "m": "discussion", "s": "speaker_turn", "n": "narrative", "l": "discussion"}


def test_clock_of_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 15), (1, 1, "assistant", "y" * 30)], "conv_id long, turn long, role string, text string")
    assert [(r.t0_ms, r.t1_ms) for r in from_conversations(df).orderBy("pos").collect()] == [(0, 1000), (1000, 3000)]


def test_fusion(spark):
    rows = [(130.0, 145.0, 128.0, 148.0, ["A", "b"], ["a", "B"]), (0.0, 10.0, 0.0, 10.0, ["a"], ["b"]), (0.0, 1.0, None, None, [], []), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s0 double, s1 double, v0 double, v1 double, a array<string>, b array<string>")
    s = video.fusion(*[F.col(c) for c in ("s0", "s1", "v0", "v1", "a", "b")])
    assert [(r[0], r[1]) for r in df.select(s, video.fusion_label(s)).collect()] == [(0.875, "strong"), (0.4, "weak"), (0.3, "weak"), (0.0, "none")]


def test_usage(spark):
    calls = spark.createDataFrame([("gemini-2.5-flash", 1_000_000, 1_000_000, 0), ("ollama/x", 5, 5, 0), ("new", 1_000_000, 0, 0), ("gemini-2.5-flash", 100, 0, 100)], "model string, in_tokens long, out_tokens long, cached_tokens long")
    got = {r.model: r for r in usage.ledger(calls).collect()}
    assert got["gemini-2.5-flash"].cost == 2.800008 and got["ollama/x"].cost == 0 and got["new"].cost == 0.3
    assert [got[k].estimated for k in ("gemini-2.5-flash", "ollama/x", "new")] == [False, False, True]
    units = spark.createDataFrame([("d", k, f"text {k} </chunk>") for k in range(14)], "doc_id string, unit_id int, content string")
    sizes = sorted(r.units for r in usage.batches(units).collect())
    assert sizes == [2, 6, 6] and usage.enrich(units).count() == 3
    assert "</chunk>\n</chunk>" not in usage.batches(units).first().prompt


def test_windows_and_scores(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(1000, 2000)))), (2, "")], "doc_id long, text string")
    got = [(r.start, r.n_tokens) for r in retrieval.fixed_windows(df).orderBy("window").collect()]
    assert got == [(0, 512), (448, 512), (896, 512), (1344, 512), (1792, 208)]
    scored = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (1, 12, 9), (2, 10, 1)], "probe_id int, unit_id int, score int")
    truth = spark.createDataFrame([(1, 11), (2, 99)], "probe_id int, unit_id int")
    r = retrieval.retrieval_scores(scored, truth, 2).first()
    assert (r.probes, r.recall_at_k, r.precision_at_k, r.mrr) == (2, 0.0, 0.0, round(1 / 3 / 2, 6))


def test_preservation_and_links(spark):
    edges = spark.createDataFrame([("d", 0, 1, "parent"), ("d", 1, 2, "captions"), ("d", 2, 3, "explains"), ("d", 3, 9, "parent"), ("d", 0, 3, "next")], "doc_id string, src int, dst int, type string")
    members = spark.createDataFrame([("d", 0, 0), ("d", 1, 0), ("d", 2, 1), ("d", 3, 2)], "doc_id string, pos int, unit int")
    links = spark.createDataFrame([("d", 0, 1)], "doc_id string, unit int, target int")
    assert quality.preservation(edges, members, links).first().preservation == 0.75


def test_row_groups_of_long_sheets_go_on(spark, monkeypatch):
    """Groups are those of one fold, wherever stretches end; a row over the budget stands alone."""
    import random

    from strandline.functions.text import count_tokens, row_md

    monkeypatch.setattr(tables, "STRETCH", 70)
    draw, target = random.Random(3), 60
    rows = [(s, k, ["w " * (draw.choice([1, 3, 9, 80]) if draw.random() < 0.97 else 100), "x"]) for s in ("a", "b", "c") for k in range({"a": 500, "b": 69, "c": 141}[s])]
    df = spark.createDataFrame(rows, "sheet string, row_no int, cells array<string>")
    costs = {(r.sheet, r.row_no): r.c for r in df.select("sheet", "row_no", count_tokens(row_md(F.col("cells"))).alias("c")).collect()}
    first = spark.range(1).select(count_tokens(row_md(F.array(F.lit("a"), F.lit("b"))))).first()[0]
    want, acc, group, last = {}, None, 0, None
    for s, k, _ in rows:
        if s != last:
            acc, group, last = None, 0, s
        elif acc + costs[s, k] > target:
            acc, group = None, group + 1
        acc = (first if acc is None else acc) + costs[s, k]
        want[s, k] = group
    assert {(r.sheet, r.row_no): r.group for r in tables.row_groups(df, ["a", "b"], target).collect()} == want


def test_cross_document_links_by_parts_of_words(spark):
    from strandline.operators import quality

    units = [("a", 0, "See Sales_Q3. It is new.", "text"), ("a", 1, "the annual report says", "section"), ("b", 0, "unrelated", "text"), ("c", 5, "reports on annual reports", "section"), ("c", 6, "end", "text"), ("d", 0, "abc", "text")]
    df = spark.createDataFrame(units, "doc_id string, unit_id int, content string, element_kind string")
    names = spark.createDataFrame([("a", "first.md"), ("b", "sales_q3.csv"), ("c", "Annual Report.pdf"), ("d", "abc.txt")], "doc_id string, name string")
    got = {(r.doc_id, r.unit_id, r.target_doc, r.target_id) for r in quality.cross_document_links(df, names).collect()}
    assert got == {("a", 0, "b", 0), ("a", 1, "c", 5)}
