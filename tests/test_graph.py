from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.operators.boundary import candidates, choose_cut, cut_regions, score

ELEMENT = "doc_id string, pos int, el_id string, kind string, text string, caption_ids array<string>, page int, bbox array<double>, n_tokens int"


def elements(spark, rows):
    full = [("d", k, f"e{k}", r[0], r[1], *(r[2:] + (None,) * (3 - len(r[2:]))), 10) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, ELEMENT)


def pairs(edges):
    return {(r.src, r.dst, r.type) for r in edges.collect()}


def test_captions_declared_and_adjacent(spark):
    df = elements(spark, [
        ("caption", "Table 1: a", None, 1, [0.0, 100.0, 50.0, 110.0]), ("table", "t", None, 1, [0.0, 120.0, 60.0, 200.0]),
        ("figure", "f", ["e3"], 1, [0.0, 300.0, 9.0, 310.0]), ("caption", "Figure 1", None, 1, [0.0, 205.0, 50.0, 215.0]),
        ("figure", "far", None, 1, [0.0, 900.0, 9.0, 910.0]), ("table", "aside", None, 1, [80.0, 112.0, 90.0, 118.0]),
    ])
    assert pairs(graph.declared_captions(df)) == {(3, 2, "captions"), (2, 3, "captioned_by")}
    assert pairs(graph.adjacent_captions(df)) == {(0, 1, "captions"), (1, 0, "captioned_by")}


def test_floats_claim_captions_in_turn(spark):
    box = lambda y: [0.0, y, 50.0, y + 10]
    df = elements(spark, [("table", "a", None, 1, box(0.0)), ("caption", "c", None, 1, box(15.0)), ("table", "b", None, 1, box(28.0)), ("caption", "d", None, 1, box(80.0))])
    assert {(s, d) for s, d, t in pairs(graph.adjacent_captions(df)) if t == "captions"} == {(1, 0), (3, 2)}


def test_references_suppress_explanations(spark):
    df = elements(spark, [("paragraph", "As listed in Table 1 and fig. 2 here."), ("table", "t"), ("paragraph", "A long enough sentence without any."), ("figure", "f"), ("figure", "g")])
    refs = graph.reference_edges(df, graph.declared_captions(df))
    assert pairs(refs) == {(0, 1, "references"), (0, 4, "references")}
    resolved = graph.resolve(refs.union(graph.explaining_edges(df)).union(graph.next_edges(df)))
    assert pairs(resolved) == {(0, 1, "references"), (0, 4, "references"), (1, 2, "next"), (2, 3, "explains"), (3, 2, "illustrated_by"), (3, 4, "next")}


def test_question_edges_replace_parent(spark):
    df = elements(spark, [("heading", "Why?"), ("paragraph", "Because."), ("paragraph", "What now? Then"), ("heading", "h")])
    parents = df.withColumn("parent_pos", F.when(F.col("pos") == 1, 0))
    out = pairs(graph.resolve(graph.question_edges(df).union(graph.parent_edges(parents)).union(graph.next_edges(df))))
    assert out == {(0, 1, "answered_by"), (1, 0, "question_for"), (1, 2, "next"), (2, 3, "next")}


def test_heading_paths(spark):
    texts = ["1 Intro", "p", "1.1 Part", "p", "2 Next", "Aside", "p", "2.1 x"]
    df = elements(spark, [("paragraph" if t == "p" else "heading", t) for t in texts])
    got = {r.pos: (r.heading_path, r.level, r.parent_pos) for r in graph.heading_paths(df).collect()}
    assert got[0] == ([], 2, None) and got[1] == (["1 Intro"], None, 0)
    assert got[2] == (["1 Intro"], 3, 0) and got[3] == (["1 Intro", "1.1 Part"], None, 2)
    assert got[4] == ([], 2, None) and got[5] == (["2 Next"], 3, 4) and got[6] == (["2 Next"], None, 4)
    assert got[7] == (["2 Next"], 3, 4)


def test_title_and_unnumbered_headings(spark):
    rows = [("The Title", 1), ("p", 0), ("Abstract", None), ("p", 0), ("1 Intro", None), ("p", 0), ("Aside", None), ("p", 0), ("Other", 1), ("p", 0)]
    df = spark.createDataFrame([("d", k, "paragraph" if t == "p" else "heading", t, n or None) for k, (t, n) in enumerate(rows)], "doc_id string, pos int, kind string, text string, level int")
    got = {r.pos: (r.heading_path, r.level, r.parent_pos) for r in graph.heading_paths(df).collect()}
    assert got[1] == (["The Title"], None, 0) and got[2] == ([], 2, None) and got[3] == (["Abstract"], None, 2)
    assert got[4] == ([], 2, None) and got[5] == (["1 Intro"], None, 4) and got[6] == (["1 Intro"], 3, 4) and got[7] == (["1 Intro"], None, 4)
    assert got[8] == ([], 1, None) and got[9] == (["Other"], None, 8)


def test_overlap_and_loss(spark):
    df = spark.createDataFrame([("d", 0, 0.0, 10.0), ("d", 2, 200.0, 300.0)], "doc_id string, pos int, t0 double, t1 double")
    other = spark.createDataFrame([("d", 1, 5.0, 250.0), ("d", 3, 300.0, 400.0)], df.schema)
    assert pairs(graph.overlap_edges(df, other)) == {(0, 1, "occurs_during"), (2, 1, "occurs_during")}
    edges = spark.createDataFrame([("d", 0, 2, "parent", 1.0, 0.95), ("d", 1, 2, "next", 1.0, 0.05), ("d", 3, 1, "references", 0.9, 0.75)], "doc_id string, src int, dst int, type string, confidence double, importance double")
    assert {r.cut: r.loss for r in graph.relationship_loss(edges).collect()} == {1: 0.95, 2: 1.7, 3: 0.75, 4: 0.0}
    ask = spark.createDataFrame([("d", 2, 0, ["a"], ["b"]), ("d", 1, 0, ["a"], ["b"]), ("d", 1, 2, ["a"], ["a"])], "doc_id string, a int, b int, path_a array<string>, path_b array<string>")
    assert {(r.a, r.b): r.separation for r in graph.separation(ask, edges).collect()} == {(2, 0): 0.1, (1, 0): 0.95, (1, 2): 0.5}


def cut(spark, rows, edges=None):
    df = elements(spark, rows).withColumn("region", F.lit(0))
    return candidates(df, edges if edges is not None else graph.resolve(graph.next_edges(df)), ["region"])


def test_candidates(spark):
    got = {r.pos: r for r in cut(spark, [("paragraph", "a"), ("heading", "h"), ("paragraph", "b"), ("list_item", "c"), ("list_item", "d")]).collect()}
    assert got[1].structural_strength >= 0.8 and not got[1].vetoed and got[2].vetoed and got[4].list_continuation == 1.0
    df = elements(spark, [("paragraph", "a"), ("caption", "c"), ("figure", "f", ["e1"]), ("paragraph", "b")]).withColumn("region", F.lit(0))
    got = {r.pos: r for r in candidates(df, graph.resolve(graph.declared_captions(df).union(graph.next_edges(df))), ["region"]).collect()}
    assert got[2].vetoed and not got[1].vetoed and got[2].graph_separation == 0.1


def test_signals_agree(spark):
    rows = [("d", 0, "speech_segment", "x", 5, 0.0, 5.0, "Alice", "s1", "o1"), ("d", 1, "speech_segment", "y", 5, 7.5, 9.0, "Bob", "s2", "o2")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string, n_tokens int, t0 double, t1 double, speaker string, visual_summary string, ocr_text string").withColumn("region", F.lit(0))
    (r,) = candidates(df, graph.resolve(graph.next_edges(df)), ["region"]).collect()
    assert (r.speaker_change, r.visual_change, r.ocr_change) == (1.0, 0.85, 0.8) and r.multimodal_consensus >= 0.8


def model(tokens, losses_of, vetoes, base, target, most):
    """The cuts of one region in a plain loop."""
    start, parts, n = 0, [], len(tokens)
    while start < n:
        if sum(tokens[start:]) <= most:
            return [*parts, (start, n, False)]
        legal = [(base[k] - 1.5 * losses_of(start, k) - 0.6 * abs(sum(tokens[start:k]) - target) / target, -k) for k in range(start + 1, n) if not vetoes[k] and losses_of(start, k) < 1]
        if not legal:
            return [*parts, (start, n, True)]
        k = -max(legal)[1]
        parts.append((start, k, False))
        start = k
    return parts


def test_regions_are_cut_like_the_plain_loop(spark):
    import random

    draw = random.Random(8)
    kinds = ["paragraph", "list_item", "heading", "paragraph"]
    for _ in range(4):
        n = 14
        rows = [("d", k, draw.choice(kinds), "t", draw.randint(20, 160)) for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string, n_tokens int").withColumn("region", F.lit(0))
        ties = [("d", *sorted(draw.sample(range(n), 2)), "references", 0.9, draw.choice([0.75, 0.95, 0.3])) for _ in range(4)]
        edges = spark.createDataFrame(ties, "doc_id string, src int, dst int, type string, confidence double, importance double")
        found = {r.pos: r for r in candidates(df, edges, ["region"]).withColumn("base", score(F.lit(500), F.lit(0.0))).collect()}
        loss = lambda s, k: round(sum(t[5] for t in ties if s <= t[1] < k <= t[2]), 6)
        want = model([r[4] for r in rows], loss, [False] + [found[k].vetoed for k in range(1, n)], [0] + [found[k].base for k in range(1, n)], 500, 700)
        got = {}
        for r in cut_regions(df, edges, ["region"]).collect():
            got.setdefault(r.part, []).append((r.pos, r.overflow))
        assert [(min(v)[0], max(v)[0] + 1, v[0][1]) for _, v in sorted(got.items())] == want
        whole = choose_cut(candidates(df, edges, ["region"]), ["region"]).collect()
        assert not whole or whole[0].pos == want[0][1] or sum(r[4] for r in rows) <= 700
