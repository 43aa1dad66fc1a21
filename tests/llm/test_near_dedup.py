import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import near_dedup, queries
from strandline.llm.near_dedup import components, keep_documents, near_duplicates, shingles


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        own = (t or "").encode().lower().split()
        sets.append({tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return {(k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)}


def found(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


def texts():
    draw = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(draw.choices(vocabulary, k=30))
    for k in range(60):
        base = draw.choices(vocabulary, k=draw.randint(5, 90))
        rows.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy).upper() if draw.random() < 0.2 else "  ".join(copy))
        if k % 4 == 0:
            rows.append(passage + " " + " ".join(draw.choices(vocabulary, k=20)))
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df, words=3, percent=85)) == brute(rows, 3, 85)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    draw = random.Random(5)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for k in range(160):
        copy = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 5, 9])):
            copy[draw.randrange(150)] = f"u{draw.randrange(999)}"
        rows.append((k, " ".join(copy)))
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert found(out) == brute(rows, 3, 85)


def test_large_group_with_a_common_passage_only(spark, monkeypatch):
    passage = " ".join(f"v{k}" for k in range(100))
    own = [" ".join(f"u{k}_{n}" for n in range(32)) for k in range(40)]
    rows = [(k, f"{passage} {own[k % 40]} {'end' if k < 40 else 'other'}") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "trees_for", lambda *_: 1)
    monkeypatch.setattr(near_dedup, "DEPTH", 1)
    out = []
    for leaf in (8, 1000):
        monkeypatch.setattr(near_dedup, "LEAF", leaf)
        out.append(found(near_duplicates(df, words=3, percent=85)))
    assert out[0] == out[1] and sum(k != c for k, _, c in out[0]) > 20


def index_brute(rows, words, percent):
    """As ``brute``, over the pairs that share a shingle."""
    sets, by = [], {}
    for i, (_, t) in enumerate(rows):
        own = (t or "").encode().lower().split()
        sets.append({tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else set())
        for x in sets[-1]:
            by.setdefault(x, []).append(i)
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i, own in enumerate(sets):
        both = Counter(j for x in own for j in by[x] if j < i)
        for j, n in both.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                top[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return {(k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_whole_table_against_brute_force(spark, words, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = index_brute([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    got = found(near_duplicates(docs, words=words, percent=percent))
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.op5_minhash_near_dedup(spark, small)
    assert found(got) == index_brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_cores_in_blocks_lose_no_link(spark, monkeypatch):
    """Near copies, documents with a common passage only, and pairs among these that are linked with each other."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    draw, rows = random.Random(8), []
    base = [f"v{k}" for k in range(120)]
    for k in range(150):
        copy = base[: 120 if k % 3 else 90] + ([] if k % 3 else [f"o{k // 6}_{n}" for n in range(30)])
        for _ in range(draw.choice([0, 0, 1, 2])):
            copy[draw.randrange(len(copy))] = f"u{draw.randrange(999)}"
        rows.append((k, " ".join(copy)))
    want = brute(rows, 3, 85)
    got = found(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85))
    assert len({c for _, _, c in want}) > 10 and got == want


def test_spanning_connects_what_pairs_connect():
    draw = np.random.default_rng(6)
    for _ in range(30):
        n = int(draw.integers(2, 40))
        m = draw.integers(0, 3, (n, near_dedup.TOKENS)).astype(np.uint8)
        m[draw.integers(0, n, n // 2)] = m[0]
        same = (m[:, None] == m[None]).sum(2)
        least = int(draw.integers(75, 100))

        def classes(pairs):
            top = list(range(n))
            for i, j in pairs:
                a, b = top[i], top[j]
                top = [a if x == b else x for x in top]
            return [top.index(x) for x in top]

        edges = near_dedup.spanning(m, least)
        assert all(same[i, j] >= least for i, j in edges) and len(edges) < n
        assert classes(edges) == classes(zip(*np.nonzero(same >= least)))


def test_trees_for_a_recall():
    assert near_dedup.trees_for(0.9, 0.85) < near_dedup.trees_for(0.999, 0.85) < near_dedup.trees_for(0.999, 0.8)


def test_keep_documents(spark):
    text = " ".join(f"q{k}" for k in range(50))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (7, text + " end", 4), (None, "alone here", 5), (8, "", 6), (8, "", 7), (9, None, 8), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = keep_documents(df).collect()
    assert sorted(r.node for r in out if r.node not in (2, 3)) == [5, 6, 7, 8, 9] and sum(r.node in (2, 3) for r in out) == 1
    assert keep_documents(df.filter("false")).count() == 0 and keep_documents(df).columns == df.columns


def test_edges(spark):
    long = " ".join(f"z{k}" for k in range(60_000))
    rows = [(1, None, ""), (2, "", ""), (3, " \n\t", ""), (4, "one", ""), (5, "ONE", ""), (6, "one two", ""), (7, long, ""), (8, long + " end", ""), (7, long, ""), (None, "one", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.component_id, r.kept) for r in out}
    assert got[1] == (1, True) and got[2] == (2, True) and got[3] == (3, True)
    assert got[4] == (4, True) and got[5] == (4, False) and got[6] == (6, True) and got[8] == (7, False)
    assert got[None] == (4, False)
    assert near_duplicates(df.filter("false")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)}


def test_shingles():
    assert len(shingles("a b c d", 3)) == 2 and len(shingles("a", 3)) == 1 and len(shingles(None, 3)) == 0
    assert np.array_equal(shingles("A b", 5), shingles("a\u000bB", 5)) and not np.array_equal(shingles("É", 1), shingles("é", 1))


def test_clashing_names_of_helpers(spark):
    from pyspark.sql import functions as F

    names = ("__id", "__h", "__goes", "__first", "content", "low", "copies", "node")
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, None), (4, "other words"), (4, "other words")], "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    out = near_dedup.keep_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 4] and all(r[c] == c for r in out.collect() for c in names)
