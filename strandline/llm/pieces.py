"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

Ids are the library's for the file, whose kind is that of merges: white space becomes U+2581, one is put in front, and
neighbours merge in the order of the file's scores; a character without a piece becomes its byte pieces. No piece has
U+2581 after another character, so words are independent: each distinct word of a task is encoded once and remembered.

Merging looks at a whole word, but its result can be checked in pieces: a segmentation is the one that merging
gives if and only if each two neighbours alone, joined, are parted again where they met. So with a weight of minus infinity for
neighbours that don't fit, and else the sum of the pieces' scores, that segmentation is the only path, and a scan over
(max, +) finds it. Documents over ``chunk_chars`` are cut into chunks at fixed places. The states of a boundary are the pieces
that end at it or reach over it; a chunk yields a transfer matrix from the states of its left boundary to those of its right
one. Matrices combine associatively, first in blocks of chunks, then blocks of a document; the state at each
boundary follows, and each chunk is traced back on its own. Only the parts of a chunk before its first and after its last word
depend on boundaries; what lies between is encoded once, with the matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strandline.llm.shared import held, written

CHUNK_CHARS, BLOCK_CHUNKS, WORDS_KEPT, LONGEST_KNOWN, PAIRS_KEPT = 32_768, 256, 300_000, 60, 500_000
NEVER = -(1 << 60)
#: No piece covers more characters.
REACH = 16
UNITS = re.compile("▁*[^▁]+|▁+")
CUT = re.compile("(?<=[^▁])▁")

ENCODED = "doc_id long, ids binary, score long"


class Pieces:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.bytes, self.byte_id = [b""] * sp.get_piece_size(), {}
        self.scores = [round(sp.get_score(i)) for i in range(sp.get_piece_size())]
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.bytes[i] = bytes([int(p[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = i
                self.bytes[i] = p.replace("▁", " ").encode()
        if max(map(len, self.ids)) > REACH:
            raise ValueError("a piece is longer than the boundary states reach")
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError("a piece goes on after a word's end")
        self.known: dict[str, tuple[bytes, int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    # pieces and their neighbours

    def merged(self, text: str) -> list[str]:
        """Neighbours merged by the greatest score, of equal ones the first."""
        parts = list(text)
        while True:
            best = at = None
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging leaves ``b`` after ``a`` as they are; an empty ``a`` is a beginning."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def piece_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.byte_id[b] for b in piece.encode("utf-8", "replace")]

    def value(self, piece: str) -> int:
        return sum(self.scores[i] for i in self.piece_ids(piece))

    def walk(self, text: str, start: int, before: str, upto: int, like=None) -> tuple[list[int], list[int]]:
        """(came, score) of the places of ``text``: where the piece begins that ends there (-1 if none does) and the scores up to
        there, for pieces that begin from ``start``, after the piece ``before``, and before ``upto``.

        ``like``: the same from another state; as soon as both agree as far as a piece reaches, the rest is the same.
        """
        n, ids = len(text), self.ids
        came, score = [-1] * (n + 1), [NEVER] * (n + 1)
        came[start], score[start] = start - len(before), 0
        agreed = 0
        for p in range(start, upto):
            if like is not None:
                agreed = agreed + 1 if p > start and came[p] == like[0][p] else 0
                if agreed > REACH:
                    alive = next((q for q in range(p - REACH, p + 1) if came[q] >= 0), None)
                    if alive is not None:
                        shift = score[alive] - like[1][alive]
                        came[p + 1 :] = like[0][p + 1 :]
                        score[p + 1 :] = [v + shift if v > NEVER else NEVER for v in like[1][p + 1 :]]
                    break
            if score[p] <= NEVER:
                continue
            last = before if p == start else text[came[p] : p]
            for m in range(1, min(REACH, n - p) + 1):
                piece = text[p : p + m]
                if (m == 1 or piece in ids) and self.fits(last, piece):
                    came[p + m], score[p + m] = p, score[p] + self.value(piece)
        return came, score

    def trace(self, text: str, came: list[int], start: int, end: int) -> list[int]:
        """The ids of the pieces from ``start`` to ``end``."""
        out = []
        while end > start:
            out.append(text[came[end] : end])
            end = came[end]
        return [i for piece in reversed(out) for i in self.piece_ids(piece)]

    # whole words

    def _library(self, words: list[str]) -> list[tuple[bytes, int]]:
        found = [self.piece_ids(w) if w == "▁" else ids for w, ids in zip(words, self.library.encode([w[1:].replace("▁", " ") for w in words], num_threads=1))]
        return [(np.array(ids, "<u4").tobytes(), sum([self.scores[i] for i in ids])) for ids in found]

    def learn(self, texts: list[str]) -> None:
        """Encodes the new words of texts together."""
        words = set().union(*map(self.words_of, texts))
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        fresh = [w for w in words.difference(self.known) if len(w) <= LONGEST_KNOWN]
        self.known.update(zip(fresh, self._library(fresh)))

    def unit(self, word: str) -> tuple[bytes, int]:
        """Ids and score of a word with the U+2581 in front of it."""
        return self.known.get(word) or self._library([word])[0]

    def words_of(self, text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        return UNITS.findall("▁" + text.replace(" ", "▁")) if "" in words or "▁" in text else ["▁" + w for w in words]

    def encode(self, text: str) -> tuple[bytes, int]:
        known, unit = self.known, self.unit
        found = [known.get(w) or unit(w) for w in self.words_of(text)]
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def decode(self, ids: bytes) -> str:
        known = self.bytes
        text = b"".join([known[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ")

    # chunks

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that begin before the place ``at`` and end at it or after it."""
        found = []
        for a in range(max(0, at - REACH), at):
            for b in range(at, min(len(text), a + REACH) + 1):
                piece = text[a:b]
                if (b - a == 1 or piece in self.ids) and self.fits("", piece):
                    found.append((a, b))
        return found

    def transfer(self, text: str, low: int, high: int, first: bool, last: bool) -> tuple[np.ndarray, bytes, int, int]:
        """A chunk's matrix, the ids of its inner words, and where these begin and end (-1 if there are none).

        ``text`` is the chunk, from ``low`` to ``high``, with REACH characters around it. Rows are the left boundary's
        states (a single one before the ``first`` chunk), columns the right one's (a single one after the ``last``).
        """
        entries = [(low, low)] if first else self.states(text, low)
        leaves = [(None, high)] if last else self.states(text, high)
        cuts = [m.start() for m in CUT.finditer(text, max(low, 1), high)]  # as the lookbehind sees what is before
        out = np.full((len(entries), len(leaves)), NEVER, np.int64)
        if not cuts:
            like = None
            for row, (a, b) in enumerate(entries):
                if b > high or b == high and not last:  # the piece from before goes over the whole chunk
                    if (a, b) in leaves:
                        out[row, leaves.index((a, b))] = 0
                    continue
                came, score = self.walk(text, b, text[a:b], high, like)
                like = like or (came, score)
                out[row] = self._at(leaves, came, score)
            return out, b"", -1, -1
        begin, end = cuts[0], cuts[-1]
        inner = text[begin:end]
        ids, middle = self._words(UNITS.findall(inner)) if inner else (b"", 0)
        came, score = self.walk(text, end, "", high)
        right = self._at(leaves, came, score)
        like = None
        for row, (a, b) in enumerate(entries):
            if b > begin:
                continue
            found = self.walk(text, b, text[a:b], begin, like)
            like = like or found
            if found[1][begin] > NEVER:
                out[row] = np.where(right > NEVER, right + (found[1][begin] + middle), NEVER)
        return out, ids, begin, end

    @staticmethod
    def _at(leaves, came: list[int], score: list[int]) -> np.ndarray:
        return np.array([score[b] if a is None or came[b] == a else NEVER for a, b in leaves], np.int64)

    def _words(self, words: list[str]) -> tuple[bytes, int]:
        fresh = [w for w in set(words).difference(self.known) if len(w) <= LONGEST_KNOWN]
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
            fresh = [w for w in set(words) if len(w) <= LONGEST_KNOWN]
        self.known.update(zip(fresh, self._library(fresh)))
        found = [self.unit(w) for w in words]
        return b"".join([f[0] for f in found]), sum([f[1] for f in found])

    def traced(self, text: str, low: int, high: int, begin: int, end: int, ids: bytes, first: bool, last: bool, entry: int, leave: int) -> bytes:
        """The ids of the pieces that begin in a chunk, from the states of its boundaries; ``text`` without its inner words if
        it has such, which then begin and end at ``begin``."""
        a, b = (low, low) if first else self.states(text, low)[entry]
        if begin < 0:
            start, stop = (None, high) if last else self.states(text, high)[leave]
            if start == a and stop == b and not first:
                return b""
            came, _ = self.walk(text, b, text[a:b], high)
            return np.array(self.trace(text, came, b, stop), "<u4").tobytes()
        came, _ = self.walk(text, b, text[a:b], begin)
        head = np.array(self.trace(text, came, b, begin), "<u4").tobytes()
        stop = high if last else self.states(text, high)[leave][1]
        came, _ = self.walk(text, begin, "", high)
        return head + ids + np.array(self.trace(text, came, begin, stop), "<u4").tobytes()


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.maximum((a[:, :, None] + b[None]).max(1), NEVER)


def resolve(matrices: list[np.ndarray], entry: np.ndarray, leave: int) -> tuple[list[int], list[int]]:
    """For each of consecutive chunks the states by which the best way enters and leaves it, from the scores of the first
    one's entry states and the last one's leaving state."""
    entries = [entry]
    for m in matrices:
        entries.append(np.maximum((entries[-1][:, None] + m).max(0), NEVER))
    ways = [leave]
    for e, m in zip(entries[-2::-1], matrices[::-1]):
        ways.append(int((e + m[:, ways[-1]]).argmax()))
    ways.reverse()
    return ways[:-1], ways[1:]


def loaded(model_file: str) -> Pieces:
    return held(("pieces", model_file), lambda: Pieces(model_file))


def cut(text: str, chunk_chars: int) -> Iterator[tuple[int, str, int, int, bool, bool]]:
    """(number, the chunk with what is around it, where it begins and ends there, whether it is the first, the last)."""
    marked = "▁" + text.replace(" ", "▁")
    for k, low in enumerate(range(0, len(marked), chunk_chars)):
        high, around = min(low + chunk_chars, len(marked)), max(0, low - REACH)
        yield k, marked[around : high + REACH], low - around, high - around, low == 0, high == len(marked)


def _square(m: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(m, np.int64).reshape(rows, -1)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (little-endian unsigned 32-bit), score (the sum of the pieces' scores).

    Null and empty texts have no ids. Rows that repeat come out as often, null ids are carried along. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small = F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                pieces.learn(texts)
                found = [pieces.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64())], ["doc_id", "ids", "score"])

    chunk = {"row": pa.int64(), "doc_id": pa.int64(), "k": pa.int32(), "text": pa.string(), "low": pa.int32(), "high": pa.int32(), "first": pa.bool_(), "last": pa.bool_()}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32  # a number for each row, as ids may repeat
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held_back = []
                for c in cut(text.as_py(), chunk_chars):
                    held_back.append((row, doc_id, *c))
                    if len(held_back) == 64 or c[-1]:
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in held_back], kind) for i, kind in enumerate(chunk.values())], list(chunk))
                        held_back = []
                row += 1

    spans = {"row": pa.int64(), "doc_id": pa.int64(), "k": pa.int32(), "block": pa.int32(), "m": pa.binary(), "rows": pa.int32(), "text": pa.string(), "low": pa.int32(), "high": pa.int32(), "begin": pa.int32(), "end": pa.int32(), "ids": pa.binary(), "first": pa.bool_(), "last": pa.bool_()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for row, doc_id, k, text, low, high, first, last in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns)):
                    m, ids, begin, end = pieces.transfer(text, low, high, first, last)
                    if begin >= 0:  # the inner words are done
                        text, high, end = text[:begin] + text[end:], high - (end - begin), begin
                    out.append((row, doc_id, k, k // BLOCK_CHUNKS, m.tobytes(), len(m), text, low, high, begin, end, ids, first, last))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(spans.values())], list(spans))

    def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
        product = None
        for m, n in zip(*(pdf.sort_values("k")[c] for c in ("m", "rows"))):
            product = _square(m, n) if product is None else combine(product, _square(m, n))
        return pdf[["row", "block"]].head(1).assign(m=product.tobytes(), rows=len(product))

    def block_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        entries, leaves = resolve([_square(m, n) for m, n in zip(pdf["m"], pdf["rows"])], np.zeros(1, np.int64), 0)
        return pdf[["row", "block"]].assign(entry=entries, leave=leaves)

    def chunk_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        matrices = [_square(m, n) for m, n in zip(pdf["m"], pdf["rows"])]
        start = np.full(len(matrices[0]), NEVER, np.int64)
        start[pdf["entry"].iloc[0]] = 0
        entries, leaves = resolve(matrices, start, int(pdf["leave"].iloc[0]))
        score = sum(int(m[e, x]) for m, e, x in zip(matrices, entries, leaves))
        return pdf[["row", "k"]].assign(entry=entries, leave=leaves, score=[score] + [0] * (len(pdf) - 1))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                inner = [pieces.traced(*x) for x in zip(*(part.column(c).to_pylist() for c in ("text", "low", "high", "begin", "end", "ids", "first", "last", "entry", "leave")))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("k"), pa.array(inner, pa.binary()), part.column("score")], ["row", "doc_id", "k", "ids", "score"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pdf[["doc_id"]].head(1).assign(ids=b"".join(pdf["ids"]), score=pdf["score"].sum())

    cuts = rows.filter(~small).mapInArrow(chunks, "row long, doc_id long, k int, text string, low int, high int, first boolean, last boolean")
    matrices = cuts.repartition("row", "k").mapInArrow(scored, "row long, doc_id long, k int, block int, m binary, rows int, text string, low int, high int, begin int, end int, ids binary, first boolean, last boolean")
    matrices = written(matrices, "matrices")
    plain = matrices.select("row", "k", "block", "m", "rows")
    products = plain.groupBy("row", "block").applyInPandas(block_product, "row long, block int, m binary, rows int")
    blocks = products.groupBy("row").applyInPandas(block_states, "row long, block int, entry int, leave int")
    states = plain.join(blocks, ["row", "block"]).groupBy("row", "block").applyInPandas(chunk_states, "row long, k int, entry int, leave int, score long")
    ready = matrices.drop("m", "rows", "block").join(states, ["row", "k"])
    parts = ready.mapInArrow(traced, "row long, doc_id long, k int, ids binary, score long")
    long = parts.groupBy("row").applyInPandas(joined, ENCODED)
    return rows.filter(small).mapInArrow(whole, ENCODED).unionByName(long)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` and its rows' ``text``: what was encoded (null as empty, U+2581 as a space)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_file)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield part.append_column("text", pa.array([pieces.decode(x.as_py() or b"") for x in part.column("ids")], pa.string()))

    rows = encoded.drop("text")
    return rows.mapInArrow(texts, StructType([*rows.schema.fields, StructField("text", StringType())]))
