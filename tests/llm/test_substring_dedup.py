import random
from hashlib import sha256

import pytest

from strandline.llm import queries, substring_dedup

SCHEMA = "doc_id long, text string, h string"


def plain(rows, window=20):
    """The definition, window by window."""
    seen, out = {}, []
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if tuple(words[k : k + window]) in seen:
                gone[k : k + window] = [True] * window
            seen.setdefault(tuple(words[k : k + window]), True)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_the_query_is_the_definition(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain(rows)
    assert rows_of(queries.op13_substring_dedup(spark, small)) == want and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize("seed, words, window, shard", [(1, 2, 4, 1 << 17), (2, 3, 6, 64), (3, 40, 5, 100), (4, 1, 20, 1 << 17)])
def test_few_words(spark, monkeypatch, seed, words, window, shard):
    """Texts of few different words, whose windows overlap themselves; small shards."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 50)
    draw = random.Random(seed)
    passages = [[f"w{draw.randrange(words)}" for _ in range(draw.randrange(1, 30))] for _ in range(6)]
    rows = []
    for k in range(60):
        text = sum((draw.choice(passages) if draw.random() < 0.5 else [f"w{draw.randrange(words)}"] * draw.randrange(9) for _ in range(5)), [])
        rows.append((k, draw.choice([" ", "\n", "\t\x0b "]).join(text)))
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    assert rows_of(substring_dedup.repeated_passages(df, window)) == plain(rows, window)


def test_an_anchor_whose_first_place_has_other_words(spark):
    """A passage that comes twice, while its words are somewhere before between others."""
    draw = random.Random(9)
    new = lambda n: [f"n{draw.randrange(10**9)}" for _ in range(n)]
    passage = new(40)
    rows = [(k, " ".join(new(15) + passage[k : k + 12] + new(15))) for k in range(28)]
    rows += [(100 + k, " ".join(new(10) + passage + new(10))) for k in range(3)]
    found = rows_of(substring_dedup.repeated_passages(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)))
    assert found == plain(rows) and sum(r[2] for r in found) == 80


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (4, "x " + text), (None, text), (5, " ".join(["a"] * 50)), (6, text.replace("w9", "W9"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    found = substring_dedup.repeated_passages(df).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert len(found) == len(rows) and by[1] == by[2] == by[3] == [(0, 0)]
    assert by[None] == [(30, 30)] and by[5] == [(1, 0)] and by[6] == [(30, 20)]
    assert sorted(by[4]) in ([(30, 0), (30, 0), (31, 30)], [(30, 30), (30, 30), (31, 0)])
    assert substring_dedup.repeated_passages(df.limit(0)).collect() == []
    with pytest.raises(TypeError):
        substring_dedup.repeated_passages(df, id_col="text", text_col="h")


def test_texts_without_their_repeats_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text + "\nown  end", 7), (2, "before " + text + " after", 8), (3, "two  words", 9), (4, None, 1), (5, text, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __left int").withColumns({c: df_lit(c) for c in ("__id", "__key", "h", "base", "spans")})
    out = substring_dedup.drop_repeated_passages(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r["__left"]) for r in out.collect()) == [(1, text + "\nown  end", 7), (2, "before after", 8), (3, "two  words", 9), (4, None, 1), (5, "", 2)]


def df_lit(name):
    from pyspark.sql import functions as F

    return F.lit(name)
