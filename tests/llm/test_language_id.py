import itertools
import math

import numpy as np
import pytest

from strandline.llm import language_id, queries
from strandline.llm.lattice import PieceTable, lattices, log_backward, log_forward, log_forward_words, log_ways, long_grid
from strandline.llm.queries import tokenizer_file


def test_forward_sums_all_segmentations():
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    prob = np.append(np.array([0.3, 0.2, 0.2, 0.2, 0.1]), [0.01, 0.0])[:, None]
    for word in ("a", "abab", "babaab", "xab"):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, at = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[at:k])
                    at = k
            total += math.prod(prob[pieces[p], 0] if p in pieces else (0.01 if len(p) == 1 else 0.0) for p in parts)
        (_, grid), = lattices([word], PieceTable(pieces), 5)
        assert np.exp(log_forward_words(grid, prob)[0, 0]) == pytest.approx(total)
        with np.errstate(divide="ignore"):
            alpha, beta = log_ways(grid, np.log(prob[:, 0]))
        assert np.exp(alpha[0, -1]) == pytest.approx(total) and np.exp(beta[0, 0]) == pytest.approx(total)


def test_long_words_sum_all_segmentations_too():
    pieces = {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}
    prob = np.append(np.array([0.3, 0.2, 0.2, 0.2, 0.1]), [0.01, 0.0])[:, None]
    with np.errstate(divide="ignore"):
        logs = np.log(prob)
    for word in ("a", "xab", "abab" * 9):
        table = PieceTable(pieces)
        (_, grid), = lattices([word], table, 5)
        own = long_grid(word, table, 5)
        assert np.array_equal(own, grid[0])
        want = log_forward_words(grid, prob)[0, 0]
        assert log_forward(own, logs)[-1, 0] == pytest.approx(want) and log_backward(own, logs)[0, 0] == pytest.approx(want)
    assert np.isfinite(log_forward(long_grid("abx" * 3000, PieceTable(pieces), 5), logs)[-1, 0])


def test_scores_do_not_change_at_a_length(monkeypatch):
    """A word's score and the fitted model are the same on both ways."""
    file = tokenizer_file("piece_bpe_32k.model")
    vocab = language_id.vocabulary(file)
    counts = {"▁" + w: k + 1 for k, w in enumerate(["donaudampfschifffahrt", "gesellschaft", "the", "other"])}
    fits, scores = [], []
    for long in (3, 40):
        monkeypatch.setattr(language_id, "LONG", long)
        prob = language_id.fit(counts, vocab)
        fits.append(prob)
        scores.append(language_id.Scorer(["x", "y"], np.stack([prob, np.append(np.full(len(prob) - 1, 1 / len(prob)), 0)], 1), vocab).score(["donaudampfschifffahrt", "the other"])[1])
    assert fits[0] == pytest.approx(fits[1]) and scores[0] == pytest.approx(scores[1])


def test_unlikely_letters_do_not_underflow(monkeypatch):
    """39 letters outside of the vocabulary at 1e-9 each, beside a language in which they are likelier."""
    vocab = language_id.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    prob = np.full((vocab.unknown + 2, 2), 1e-9)
    prob[vocab.unknown, 1] = 1e-8
    prob[-1] = 0
    word = "\u16a0" * 39
    for long in (3, 40):
        monkeypatch.setattr(language_id, "LONG", long)
        scorer = language_id.Scorer(["x", "y"], prob, vocab)
        assert scorer.score([word]) == (["y"], [pytest.approx(1.0)])
        assert scorer.logs[scorer.words["▁" + word]] == pytest.approx([40 * np.log(1e-9), np.log(1e-9) + 39 * np.log(1e-8)])
    counts = {"▁" + word: 10**9, "▁the": 1}
    assert np.isfinite(language_id.fit(counts, vocab)).all()


def test_query_over_the_whole_table(spark, small):
    import zlib

    rows = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = queries.op3_language_id(spark, small).collect()
    assert sorted(r.doc_id for r in out) == sorted(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.filter(~language_id.held_out()), tokenizer_file("piece_bpe_32k.model"))
    assert model[0] == ["de", "en", "es", "fr"]
    rows = language_id.identify(docs, model, tokenizer_file("piece_bpe_32k.model")).join(docs.filter(language_id.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    file = tokenizer_file("piece_bpe_32k.model")
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1), (4, "12 ..", None, 1), (5, "", "de", 1), (None, "ж" * 5000, None, 1), (1, "the cat and the dog", "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.train(docs, file)
    out = language_id.identify(docs, model, file).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}
    none = docs.filter("false")
    assert language_id.train(none, file)[0] == []
    assert {r.lang_pred for r in language_id.identify(docs, ([], np.zeros((0, 0))), file).collect()} == {"und"}
    assert language_id.identify(none, model, file).count() == 0
    assert language_id.identify_rows(docs, model, file).columns == ["doc_id", "text", "lang", "lang_pred", "score"]
