import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F
from strandline.llm import queries
from strandline.llm import line_dedup
from strandline.llm.line_dedup import drop_repeated_lines, line_decisions, repeated_lines, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def brute(rows, edits, least):
    first = {}
    for k, text in sorted(rows):
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= least:
                first.setdefault(line, (k, no))
    out = {}
    for k, text in rows:
        for no, line in enumerate((text or "").split("\n")):
            if len(line) >= least and ((k, no) != first[line] or any(p < first[line] and abs(len(o) - len(line)) <= edits and distance(o, line) <= edits for o, p in first.items() if o != line)):
                out.setdefault(k, []).append(no)
    return out


def found(df):
    return {r.doc_id: list(r.dropped) for r in df.collect()}


def test_against_brute_force(spark):
    draw = random.Random(6)
    lines = ["".join(draw.choices("abcé ", k=draw.randint(3, 30))) for _ in range(25)]
    for line in list(lines):
        for _ in range(3):
            new = list(line)
            for _ in range(draw.randint(0, 4)):
                at = draw.randrange(len(new) + 1)
                new[at : at + draw.randint(0, 1)] = draw.choice(["", "z", "yy"])
            lines.append("".join(new))
    rows = [(k, "\n".join(draw.choices(lines, k=draw.randint(1, 5)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for edits in (1, 2, 3):
        assert found(repeated_lines(df, edits, 8)) == brute(rows, edits, 8)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    draw, pairs = random.Random(edits), []
    for _ in range(400):
        a = "".join(draw.choices("abé😀", k=draw.randint(4, 40)))
        b = list(a)
        for _ in range(draw.randint(0, edits + 2)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "zz"])
        b = "".join(b)
        if b and abs(len(a) - len(b)) <= edits:
            pairs.append((a, b, distance(a, b) <= edits))
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", within("a", "b", edits).alias("got"))
    assert len(pairs) > 100 and df.filter("want is distinct from got").count() == 0


def test_frequent_line_and_edges(spark):
    line, long = "one line that is everywhere", "very long " * 20_000
    rows = [(k, f"{line}\nown line of the document {k * k * 7919}") for k in range(300)] + [(500, None), (501, ""), (502, long), (503, long), (504, "\n\nshort\nshort")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, line int")
    got = found(repeated_lines(df))
    assert all(0 in got[k] for k in range(1, 300)) and 0 not in got.get(0, []) and got[503] == [0]
    assert not {500, 501, 502, 504} & set(got)
    kept = {r.doc_id: r.text for r in drop_repeated_lines(df).collect()}
    assert 503 not in kept and kept[500] is None and kept[504] == "\n\nshort\nshort" and kept[0].startswith(line) and line not in kept[7]
    assert drop_repeated_lines(df).columns == df.columns
    assert repeated_lines(df.filter("false")).count() == 0


def test_null_ids_come_last(spark):
    rows = [(None, "a line of some length here"), (3, "a line of some length here"), (3, "a line of some length here")]
    assert found(repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == {None: [0]}


def test_plan_is_native(spark, small):
    plan = repeated_lines(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_short_lines_are_compared_exactly(spark):
    texts = ["Les.\nAnd ornd.\n\n \t", "Les.\na line of some length here\nLes!\n\n \t", "a line of some length herE\nown short\n\n \t\nAnd ornd.\nown short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(repeated_lines(df, exact_short=True)) == {1: [0], 2: [0, 4, 5]}
    assert found(repeated_lines(df)) == {2: [0]}
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert kept[1] == "a line of some length here\nLes!\n\n \t"


@pytest.mark.parametrize("name", ["op9_line_dedup", "op9_line_dedup_short_lines"])
def test_queries_equal_their_sql(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{small}/documents.parquet'")
    rows = {tuple(r) for r in queries.queries()[name](spark, small).collect()}
    assert rows == set(duck.sql(queries.oracle_sql()[name]).fetchall()) and len(rows) == docs.count()


def test_short_lines_outlive_a_dropped_line(spark):
    line = "the license line that all of them have"
    rows = [(0, line), (1, f"{line}\nmine\n \nown"), (2, f"{line}\n \t\n"), (3, f"{line}\nmine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in drop_repeated_lines(df).collect()} == {0: line, 1: "mine\n \nown", 3: "mine"}
    assert {r.doc_id: r.text for r in drop_repeated_lines(df, exact_short=True).collect()} == {0: line, 1: "mine\n \nown"}


def test_rows_that_share_an_id_lose_their_own_lines_only(spark):
    rows = [(1, "first line of the first row of all\nthe line that both rows have in common"), (1, "the line that both rows have in common\nsecond row says a thing found nowhere else at all"), (2, "x"), (2, "x"), (None, "the line that both rows have in common\nmine, though there is no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text for r in drop_repeated_lines(df, exact_short=True).collect()]
    assert sum("second row says" in t for t in kept) == sum("first line of" in t for t in kept) == 1
    assert sum("that both rows" in t for t in kept) == 1 and kept.count("x") == 1 and "mine, though there is no id" in kept
    words = spark.createDataFrame([("b", "the line that both rows have in common"), ("a", "the line that both rows have in common\nand another of its own here")], "doc_id string, text string")
    assert {r.doc_id: r.text.count("\n") for r in drop_repeated_lines(words).collect()} == {"a": 1}


def test_null_ids_in_the_query(spark, tmp_path):
    line = "a line of some length here"
    spark.createDataFrame([(1, line), (None, line)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.n_dropped, r.dropped) for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == {(1, 0, ""), (None, 1, "0")}


def test_clashing_names(spark):
    names = ("__dropped", "__place", "__of", "__before", "dropped", "h1", "h2", "no", "line", "n", "count")
    df = spark.createDataFrame([(1, "a line of some length here"), (2, "a line of some length here\nown line of this document")], "doc_id long, text string")
    df = df.select("*", *[F.lit(c).alias(c) for c in names])
    for docs in (df, df.union(df)):
        out = drop_repeated_lines(docs)
        assert out.columns == df.columns and all(r[c] == c for r in out.collect() for c in names)
        assert sorted(r.text for r in out.collect()) == ["a line of some length here", "own line of this document"]


def links_of(df, **options):
    """How many others each line is within the edits of, by its hash."""
    return {r.h1: r.links for r in line_decisions(df, **options).collect()}


@pytest.mark.parametrize(("edits", "shared"), [(1, 1), (2, 1), (3, 4)])
def test_hot_segments_lose_no_pair(spark, edits, shared):
    draw, lines = random.Random(shared * 10 + edits), set()
    frames = ["the same frame of words around {} and what comes after it", "{} é before a frame that they share", "aaaaaaaaaaaaaaaaaaaaaaaa{}aaaaaaaaaaaa", "ends with a number: {}"]
    for _ in range(100):
        line = draw.choice(frames).format("".join(draw.choices("ab7", k=draw.randint(1, 8))))
        lines.add(line)
        cut = list(line)
        for _ in range(draw.randint(0, edits + 1)):
            at = draw.randrange(len(cut) + 1)
            cut[at : at + draw.randint(0, 1)] = draw.choice(["", "z", "a"])
        lines.add("".join(cut))
    lines = sorted(line for line in lines if len(line) >= 12)
    df = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "doc_id long, text string")
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = {hashes[x]: sum(x != y and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in lines) for x in lines}
    assert links_of(df, max_edits=edits, min_chars=12, shared=shared) == want


def test_template_lines_do_not_meet_pair_by_pair(spark):
    def met(n):
        draw = random.Random(n)
        rows = [(k, f"this text stands in every line of the template, {''.join(draw.choices('abcdefghijklmnopqrstuvwxyz', k=24))} is all it has of its own") for k in range(n)]
        named = spark.createDataFrame(rows, "h1 long, line string").select("h1", "line", F.length("line").alias("n"), F.lit(0).cast("long").alias("counts"))
        return line_dedup._candidates(named, 2, line_dedup.SHARED)[0].count()

    assert met(1000) < 100 and met(2000) < 200  # 499,500 and 1,999,000 pairs share a segment
