import array
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from strandline.llm import packing, queries
from strandline.llm.packing import ByteBpe, candidates, choose_cuts, pack
from strandline.llm.queries import tokenizer_file

VOCABULARY = tokenizer_file("byte_bpe_50k.json")


def tokenizer():
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def least_cost(points, penalties, window):
    best = [0] + [None] * (len(points) - 1)
    for j in range(1, len(points)):
        best[j] = min(best[i] + window - (points[j] - points[i]) + penalties[j] for i in range(j) if points[j] - points[i] <= window)
    return best[-1]


def test_cuts_are_optimal():
    draw = random.Random(2)
    for _ in range(200):
        lengths = np.array([draw.randint(0, 14) for _ in range(draw.randint(1, 30))])
        ends = np.array([draw.random() < 0.3 for _ in lengths])
        points, penalties = candidates(lengths, ends, 10)
        cuts = choose_cuts(points, penalties, 10)
        penalty = dict(zip(points, penalties))
        for p, x in zip(points, penalties):  # of several candidates at a place the cheapest
            penalty[p] = min(penalty[p], x)
        cost = sum(10 - (b - a) + (penalty[b] if b else 0) for a, b in zip(cuts, cuts[1:]))
        assert all(0 <= b - a <= 10 for a, b in zip(cuts, cuts[1:])) and cost <= least_cost(points, penalties, 10)


def check(rows, out, window):
    t, pieces, sequences = tokenizer(), defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(list)
    for k, text in rows:
        want[k].append(array.array("I", t.encode(text or "", add_special_tokens=False).ids + [1]).tobytes())
    for k, own in pieces.items():
        if len(want[k]) == 1:
            own.sort(key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in own) == want[k][0]
            assert all(a.start + a.length == b.start for a, b in zip(own, own[1:])) and own[0].doc_tokens == len(want[k][0]) // 4
    assert set(pieces) == set(want) and sum(r.length for r in out) == sum(len(x) // 4 for v in want.values() for x in v)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:])) and sum(r.length for r in own) <= window


def test_whole_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, pack(docs, VOCABULARY).collect(), 2048)


def test_blocks_and_odd_white_space(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 300)
    odd = ["a.  b", "x\n\n\ny. Z", " lead", "trail ", "tab\tand nbsp.  wide", "don't stop! Now? <|endoftext|> é漢字", "\x1c\x00", "no end " * 900, "", None, "e.\n f"]
    rows = [(k, odd[k % len(odd)]) for k in range(60)] + [(7, "again"), (None, "none")]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), VOCABULARY, window=64).collect()
    check(rows, out, 64)


def test_little_padding_and_empty_table(spark):
    rows = [(k, "A sentence of some words. " * (k % 40)) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = pack(df, VOCABULARY).collect()
    assert sum(r.length for r in out) > 0.98 * 2048 * len({r.sequence_id for r in out})
    assert pack(df.filter("false"), VOCABULARY).count() == 0


def test_ids_of_random_strings():
    """Words, tabs, runs of newlines, white space of all kinds, contractions, numbers, signs and other scripts."""
    draw, t, own = random.Random(9), tokenizer(), ByteBpe(VOCABULARY)
    bits = ["a", "name", "don't", "we'll", "42", "3.5", "!", "...", ". ", "? ", "\n", "\n\n", "\n\n\n", " ", " ", " ", "  ", "\t", "\r\n", "\r", "\u00a0", "\u3000", "\u2028", "\u200b", "\u180e", "\ufeff", "\x1c", "\x85", "\x0b", "\x00", "\u00e9", "\u6f22\u5b57", "\U0001f600", "e\u0301", "<|endoftext|>", "'s", "_", "x" * 30]
    texts = ["name\tage\tcity\n\n\nnext row here", "a\tb\tc\n\n\nd", "a\tb\n\n\tc"]
    for few in (bits[:12] + [" "] * 9 + ["\n"], bits):
        texts += ["".join(draw.choices(few, k=draw.randint(0, 14))) for _ in range(15_000)]
    got = [x for k in range(0, len(texts), 500) for x in own.encode(texts[k : k + 500])]
    assert all(len(ids) == 4 * n.sum() for ids, n in got)
    want = [array.array("I", x.ids).tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [w for w, g, x in zip(texts, got, want) if g[0] != x] == []


def test_query_over_the_whole_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    out, t = queries.op8_packing(spark, small).collect(), tokenizer()
    ids = {k: t.encode(text or "", add_special_tokens=False).ids + [1] for k, text in rows}
    assert {r.doc_id for r in out} == set(ids) and sum(r.length for r in out) == sum(map(len, ids.values()))
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(array.array("I", own[r.start : r.start + r.length]).tobytes())
