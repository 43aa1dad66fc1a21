"""Order-preserving packing by dynamic programming.

The documents of an input partition form one stream of token ids, an end id after each document. Window cuts are
chosen at document ends (free), sentence ends (a small penalty) and, inside sentences longer than a window, anywhere
(a large one), so that padding plus penalties are least: key[j] = min(key[i] : j - i <= window) + window + penalty[j],
the minimum by a monotone queue. A stream is cut block by block, the last window of a block going on into the next, so
memory is bounded by a block; nothing is shuffled, and a partition has at most one short window.

Ids are those of the tokenizers file. Where white space is single spaces and newlines only, a pre-token never goes on over
one: a space begins the next, a newline is one by itself. So words are encoded once and remembered; a text with any other
white space is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections import deque
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandline.llm.shared import held

WINDOW = 2048
END_ID = 1
SENTENCE_PENALTY, INNER_PENALTY = 8, 256
BLOCK_TOKENS, BATCH_BYTES, WORDS_KEPT, SLICE = 1 << 20, 16 << 20, 800_000, 200

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: A sentence ends before this white space.
SLOW_END = re.compile(r"(?<=[.!?])(?=\s)|(?<=\S)(?=\n)")
#: White space of any kind but single spaces and newlines inside a text, and the sign that marks sentence ends meanwhile.
ODD = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"] + ["  ", " \n", "\n ", "\n\n", "\0"]


def _signs() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


# Fixed value: how byte-level vocabularies of this kind cut texts before merging.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Words(dict):
    """The ids of words as they follow a space, of those with a newline in front that begin a line, with \\0 that begin a text."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        own = word if word[:1] == "\n" else word[1:] if word[:1] == "\0" else " " + word
        ids = array("I", self.encode(own)).tobytes()
        if len(word) < 100:
            self[word] = ids
        return ids


class ByteBpe:
    """Whole texts to little-endian 32-bit ids, as the tokenizers file says; special tokens' strings are text.

    The file's merges, which it numbers in their order, are also given to an engine that is quicker with single words;
    a file of another order has all texts encoded as a whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        model = json.load(open(tokenizer_file, encoding="utf-8"))["model"]
        sign = _signs()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [a + b for a, b in pairs]
        ordered = [model["vocab"][t] for t in merged]
        self.known = None
        if ordered == list(range(256, 256 + len(merged))) and sorted(model["vocab"][t] for t in sign) == list(range(256)):
            ranks = {bytes(sign[c] for c in t): k for t, k in ((t, model["vocab"][t]) for t in [*sign, *merged])}
            engine = tiktoken.Encoding("words", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
            self.known = _Words(engine.encode_ordinary)

    def encode(self, texts: list[str]) -> list[tuple[bytes, np.ndarray]]:
        """The ids of each text, and how many of them each of its sentences has."""
        return [self._joined(*parts) if (parts := self._parts(t)) else self._whole(t) for t in texts]

    def _joined(self, words: list[str], begins: list[int]) -> tuple[bytes, np.ndarray]:
        found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return b"".join(found), np.add.reduceat(sizes, begins) // 4

    def _parts(self, text: str) -> tuple[list[str], list[int]] | None:
        """The words, and where in them sentences begin; None if white space is odd."""
        if self.known is None or not text or text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, ODD)):
            return None
        marked = text.replace(". ", ".\0 ").replace("! ", "!\0 ").replace("? ", "?\0 ").replace("\n", "\0 \n")
        counts = [p.count(" ") for p in marked.split("\0")]
        counts[0] += 1
        words = marked.replace("\0", "").split(" ")
        words[0] = "\0" + words[0]
        return words, [0, *accumulate(counts[:-1])]

    def _whole(self, text: str) -> tuple[bytes, np.ndarray]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        ends = [m.start() for m in SLOW_END.finditer(text)]
        at = np.searchsorted(np.array([a for a, _ in found.offsets]), ends).tolist() if ends and found.ids else []
        cuts = [0, *sorted(set(at) - {0, len(found.ids)}), len(found.ids)]
        return np.array(found.ids, "<u4").tobytes(), np.diff(cuts)


def choose_cuts(points: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Of the ascending ``points`` (0 first, at most ``window`` apart) those that cut, 0 and the last among them."""
    keys, queue, head, back = [0], [0], 0, [0]
    first = 0  # the point at the queue's head
    for j in range(1, len(points)):
        least = points[j] - window
        while first < least:
            head += 1
            first = points[queue[head]]
        back.append(queue[head])
        key = keys[head] + window + penalties[j]
        while keys[-1] >= key and len(keys) > head:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
        if len(keys) == head + 1:
            first = points[j]
    at, cuts = len(points) - 1, []
    while at:
        cuts.append(points[at])
        at = back[at]
    return [0, *reversed(cuts)]


def candidates(lengths: np.ndarray, is_doc_end: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Cut points and penalties from the token counts of sentences; a sentence over a window is cut each window too."""
    ends = np.cumsum(lengths)
    if len(lengths) and lengths.max() > window:
        inner = np.concatenate([np.arange(e - n + window, e, window) for e, n in zip(ends, lengths) if n > window])
        ends = np.concatenate([ends, inner])
        kind = np.concatenate([np.where(is_doc_end, 0, SENTENCE_PENALTY), np.full(len(inner), INNER_PENALTY)])
        order = np.argsort(ends, kind="stable")
        ends, kind = ends[order], kind[order]
    else:
        kind = np.where(is_doc_end, 0, SENTENCE_PENALTY)
    return [0, *ends.tolist()], [0, *kind.tolist()]


class _Stream:
    """The open part of a partition's stream: documents not yet cut off, as (doc_id, ids, start, sentence lengths)."""

    def __init__(self, window: int, base: int):
        self.window, self.sequence = window, base
        self.docs: deque[list] = deque()
        self.tokens = 0

    def add(self, doc_id, ids: bytes, sentences: np.ndarray) -> None:
        ids += END_ID.to_bytes(4, "little")
        sentences[-1] += 1
        self.docs.append([doc_id, ids, 0, sentences])
        self.tokens += len(ids) // 4

    def cut(self, last: bool) -> list[tuple]:
        if not self.tokens:
            return []
        lengths = np.concatenate([d[3] for d in self.docs])
        ends = np.zeros(len(lengths), bool)
        ends[np.cumsum([len(d[3]) for d in self.docs]) - 1] = True
        cuts = choose_cuts(*candidates(lengths, ends, self.window), self.window)
        if not last:
            cuts = cuts[:-1]  # the last window stays open
        rows, at, k, upto = [], 0, 0, cuts[-1]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            while at < hi:
                doc_id, ids, start, _ = doc = self.docs[0]
                n = min(hi - at, len(ids) // 4 - start)
                rows.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, self.sequence + k, at - lo))
                at += n
                doc[2] += n
                if doc[2] == len(ids) // 4:
                    self.docs.popleft()
        self.sequence += len(cuts) - 1
        self.tokens -= upto
        if self.docs and self.docs[0][2]:  # the first document's sentences that are left
            doc = self.docs[0]
            ends = np.cumsum(doc[3])
            gone = ends[-1] - (len(doc[1]) // 4 - doc[2])
            first = np.searchsorted(ends, gone, "right")
            doc[3] = doc[3][first:].copy()
            doc[3][0] = ends[first] - gone
        return rows


def _batches(rows: list[tuple]):
    size = from_ = 0
    for i, r in enumerate(rows):
        size += len(r[3]) + 56
        if size > BATCH_BYTES or i == len(rows) - 1:
            c = list(zip(*rows[from_ : i + 1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"), c)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            size, from_ = 0, i + 1


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset. The ids of a document with the end id lie in exactly one piece each, sequences hold at most
    ``window`` ids, offsets in a sequence have no gaps, and documents keep the order in which they are read.

    Null text counts as empty: such a document is its end id. Null and repeated ids are carried along; a document is
    a row. An empty table gives an empty result; other columns are not looked at. ``sequence_id`` is the number of the
    input partition times 2**32 and a running number.
    """

    def packed(batches):
        bpe = held(("bpe", tokenizer_file), lambda: ByteBpe(tokenizer_file))
        stream = _Stream(window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, (ids, sentences) in zip(part.column(0).to_pylist(), bpe.encode(texts)):
                    stream.add(doc_id, ids, sentences)
                    if stream.tokens >= BLOCK_TOKENS:
                        yield from _batches(stream.cut(False))
        yield from _batches(stream.cut(True))

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(packed, PIECES)
