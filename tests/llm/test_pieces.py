import random

import numpy as np
import pytest

from strandline.llm import queries
from strandline.llm.pieces import Pieces, combine, cut, decode, encode, resolve
from strandline.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return Pieces(MODEL)


def by_chunks(p: Pieces, text: str, size: int):
    """Ids by chunks, and the score of the product of their matrices."""
    chunks = list(cut(text, size))
    scored = [p.transfer(*c[1:]) for c in chunks]
    entries, leaves = resolve([m for m, *_ in scored], np.zeros(1, np.int64), 0)
    out, product = b"", scored[0][0]
    for m, *_ in scored[1:]:
        product = combine(product, m)
    for (_, t, low, high, first, last), (_, ids, begin, end), entry, leave in zip(chunks, scored, entries, leaves):
        if begin >= 0:
            t, high, end = t[:begin] + t[end:], high - (end - begin), begin
        out += p.traced(t, low, high, begin, end, ids, first, last, entry, leave)
    assert product.shape == (1, 1)
    return np.frombuffer(out, "<u4").tolist(), int(product[0, 0])


@pytest.mark.parametrize("letters", ["abcdeéth▁in ж", "the and ing ", "   ab", "aaab", "漢字ab\n😀", "\t .,-0123456789"])
def test_chunks_equal_the_library(own, letters):
    draw = random.Random(4)
    for _ in range(40):
        text = "".join(draw.choice(letters) for _ in range(draw.choice([1, 5, 17, 40, 200])))
        want = own.library.encode(text.replace("▁", " "))
        for size in (1, 3, 5, 16, 37, 64):
            ids, score = by_chunks(own, text, size)
            assert ids == want and score == sum(own.scores[i] for i in want)


def test_products_are_associative(own):
    matrices = [own.transfer(*c[1:])[0] for c in cut("internationalisations" * 9, 20)]
    left = right = None
    for m in matrices:
        left = m if left is None else combine(left, m)
    for m in reversed(matrices):
        right = m if right is None else combine(m, right)
    assert np.array_equal(left, right)


def test_merging_equals_the_library(own):
    draw = random.Random(5)
    for _ in range(300):
        word = "▁" + "".join(draw.choice("theandionsé") for _ in range(draw.randint(1, 14)))
        assert [own.ids[x] for x in own.merged(word)] == own.library.encode(word[1:])


def test_all_documents_equal_the_library(spark, small, own):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for size in (1000, 10**9):
        back = decode(encode(docs, MODEL, chunk_chars=size), MODEL).join(docs.withColumnRenamed("text", "own"), "doc_id").collect()
        assert len(back) == docs.count() and all(r.text == r.own for r in back)
        for r in back:
            want = own.library.encode(r.own)
            assert np.frombuffer(r.ids, "<u4").tolist() == want and r.score == sum(own.scores[i] for i in want)


def test_query_over_the_whole_table(spark, small, own):
    import zlib

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op1_sentencepiece(spark, small).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)
    for r in out:
        ids = own.library.encode(rows[r.doc_id])
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_crc32, r.decoded_chars) == (zlib.crc32(rows[r.doc_id].encode()), len(rows[r.doc_id]))


def test_edges(spark):
    long = "nobreak" * 3000
    rows = [(1, None, 0), (2, "", 0), (3, " ", 0), (4, "a  b \n c ", 0), (5, long, 0), (5, long, 0), (6, "漢字é😀", 0), (None, long + " x", 0), (None, long + " x", 0), (4, "a  b \n c ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = decode(encode(df, MODEL, chunk_chars=4000), MODEL).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((k, t or "") for k, t, _ in rows), key=key)
    assert encode(df.filter("false"), MODEL).count() == 0
