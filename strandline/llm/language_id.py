"""Language identification by segmentation-marginalised unigrams.

A word's probability in a language is the sum, over all its segmentations into pieces of a fixed public vocabulary, of
the product of the pieces' probabilities in that language: a forward algorithm, run once for each distinct word of a
task and remembered. A text's score sums its words' logarithms. The piece probabilities are fitted by expectation
maximisation on a sample of the labelled rows of about ``TRAIN_DOCS`` a language.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strandline.llm.lattice import PieceTable, lattices, log_backward, log_forward, log_forward_words, log_ways, long_grid
from strandline.llm.shared import given_back, held

#: The bound of the sample that the model is fitted on: labelled documents of a language, in expectation.
TRAIN_DOCS = 500
ROUNDS, SMOOTHING, WORDS_KEPT = 3, 0.05, 400_000
#: Longer words are segmented one by one; the sums are the same.
LONG = 40
UNDETERMINED = "und"


class Vocabulary:
    """The lower-case letter pieces of a SentencePiece file, word starts marked by U+2581; the last id: any other letter."""

    def __init__(self, model_file: str):
        import regex
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        pieces = [p for p in pieces if (b := p.removeprefix("▁")) == "" or b.isalpha() and b == b.lower()]
        self.ids = {p: k for k, p in enumerate(pieces) if p}
        self.unknown = len(self.ids)
        self.table = PieceTable(self.ids)
        self.letters = regex.compile(r"\p{L}+")

    def words(self, chunk: str) -> list[str]:
        """The letter runs of a text without white space, in lower case."""
        return ["▁" + r.lower() for r in self.letters.findall(chunk)]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(model_file: str) -> Vocabulary:
    if model_file not in _VOCABULARIES:
        _VOCABULARIES[model_file] = Vocabulary(model_file)
    return _VOCABULARIES[model_file]


def fit(counts: Counter, vocab: Vocabulary) -> np.ndarray:
    """Piece probabilities by expectation maximisation from the counts of words of one language."""
    words = [w for w in counts if len(w) <= LONG]
    longer = [(counts[w], long_grid(w, vocab.table, vocab.unknown)) for w in counts if len(w) > LONG]
    weight = np.array([counts[w] for w in words], float)
    size = vocab.unknown + 1
    prob = np.append(np.full(size, 1 / size), 0.0)[:, None]
    for _ in range(ROUNDS):
        expected = np.zeros(size + 1)
        with np.errstate(divide="ignore"):
            logs = np.log(prob)
        for own, grid in lattices(words, vocab.table, vocab.unknown):
            alpha, beta = log_ways(grid, logs[:, 0])
            for end in range(1, grid.shape[1] + 1):
                for m in range(1, min(grid.shape[2], end) + 1):
                    piece = grid[:, end - 1, m - 1]
                    share = weight[own] * np.exp(alpha[:, end - m] + logs[piece, 0] + beta[:, end] - alpha[:, -1])
                    expected += np.bincount(piece % (size + 1), share, size + 1)
        for n, grid in longer:
            alpha, beta = log_forward(grid, logs)[:, 0], log_backward(grid, logs)[:, 0]
            for m in range(1, grid.shape[1] + 1):
                piece = grid[m - 1 :, m - 1]
                share = n * np.exp(alpha[: len(alpha) - m] + logs[piece, 0] + beta[m:] - alpha[-1])
                expected += np.bincount(piece % (size + 1), share, size + 1)
        expected = expected[:size] + SMOOTHING
        prob = np.append(expected / expected.sum(), 0.0)[:, None]
    return prob[:, 0]


def train(labelled: DataFrame, model_file: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities x languages) from the rows with a label; a language without letters is left out.

    What comes to the driver is a vocabulary's size for each language. Empty input gives no languages.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, 0))
    below = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, (TRAIN_DOCS << 20) // n))])
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < below[F.col("lang")]).select("lang", "text")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        vocab, counts = vocabulary(model_file), Counter()
        for text in pdf["text"].dropna():
            for chunk, n in Counter(text.split()).items():
                for w in vocab.words(chunk):
                    counts[w] += n
        found = {"lang": [pdf["lang"].iloc[0]], "prob": [fit(counts, vocab)]} if counts else {"lang": [], "prob": []}
        given_back()
        return pd.DataFrame(found)

    found = sorted(sample.groupBy("lang").applyInPandas(fitted, "lang string, prob array<double>").collect(), key=lambda r: r.lang)
    return [r.lang for r in found], np.array([r.prob for r in found]).T


def scorer_of(name: str, spread, model_file: str) -> Scorer:
    """A worker's scorer of a broadcast model, which serves the worker's next tasks too."""
    return held(("scorer", name), lambda: Scorer(*spread.value, vocabulary(model_file)))


class Scorer:
    def __init__(self, langs: list[str], prob: np.ndarray, vocab: Vocabulary):
        self.langs, self.prob, self.vocab = langs, prob, vocab
        with np.errstate(divide="ignore"):
            self.log_prob = np.log(prob) if langs else prob
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.logs, self.size = np.zeros((1, len(self.langs))), 1

    def learn(self, chunks: list[str]) -> None:
        """Log-probabilities of chunks (words of a text with what sticks to them); one without letters gets index -1.

        Chunks of one word share the word's row, which the forward algorithm fills once.
        """
        own = [self.vocab.words(c) for c in chunks]
        words = list({w for ws in own for w in ws if w not in self.words})
        room = self.size + len(words) + len(chunks)
        if room > len(self.logs):
            self.logs = np.concatenate([self.logs[: self.size], np.zeros((room, len(self.langs)))])
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for k, grid in lattices([words[i] for i in short], self.vocab.table, self.vocab.unknown):
            for i in range(0, len(k), 4096):
                rows = [short[x] for x in k[i : i + 4096].tolist()]
                self.logs[self.size + np.array(rows)] = log_forward_words(grid[i : i + 4096], self.prob)
        for i, w in enumerate(words):
            if len(w) > LONG:
                self.logs[self.size + i] = log_forward(long_grid(w, self.vocab.table, self.vocab.unknown), self.log_prob)[-1]
        self.words.update(zip(words, range(self.size, self.size + len(words))))
        self.size += len(words)
        for c, ws in zip(chunks, own):
            if len(ws) > 1:
                self.logs[self.size] = self.logs[[self.words[w] for w in ws]].sum(0)
                self.known[c] = self.size
                self.size += 1
            else:
                self.known[c] = self.words[ws[0]] if ws else -1

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        counted = [Counter((t or "").split()) for t in texts]
        fresh = {c for counts in counted for c in counts if c not in self.known}
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.forget()
            fresh = set().union(*counted)
        self.learn(list(fresh))
        pred, score = [], []
        for counts in counted:
            at = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))[at >= 0]
            at = at[at >= 0]
            if not len(at):
                pred.append(UNDETERMINED)
                score.append(0.0)
                continue
            total = n @ self.logs[at]
            best = int(total.argmax())
            pred.append(self.langs[best])
            score.append(float(1 / np.exp(total - total[best]).sum()))
        return pred, score


def identify_rows(docs: DataFrame, model: tuple[list[str], np.ndarray], model_file: str, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with ``pred_col`` and ``score_col`` (see ``identify``) in place of columns so named."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size for each language
    rows = docs.drop(pred_col, score_col)
    name = sha256(repr((model[0], model_file)).encode() + model[1].tobytes()).hexdigest()

    def predicted(batches):
        scorer = scorer_of(name, spread, model_file)
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    pred, score = scorer.score(part.column(text_col).to_pylist())
                    yield part.append_column(pred_col, pa.array(pred, pa.string())).append_column(score_col, pa.array(score, pa.float64()))
        finally:
            scorer.forget()
            given_back()

    return rows.mapInArrow(predicted, StructType([*rows.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score, from the whole text alone.

    ``lang_pred`` is the learned language under which the text is likeliest (of equal ones the first by name), ``und``
    with score 0 if the text is null or has no letter, or nothing was learned; ``score`` is its posterior probability
    under equal priors. Repeated rows get equal values; an empty table gives an empty result; others of ``docs``'
    columns are not looked at.
    """
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text")
    return identify_rows(rows, model, model_file).select("doc_id", "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """The documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
