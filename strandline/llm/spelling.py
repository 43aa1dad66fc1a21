"""Groups of spelling variants: words one edit apart, each with its most frequent neighbour as its form.

Words are counted in tasks first. The counted words, in code-point order, become compact tries of a bounded number of
letters; as many as BROADCAST allows are broadcast at a time, and every word's Levenshtein automaton of distance one is
intersected with each of them: it goes down the trie with the states that are alive (no edit yet; one edit, the word a letter
behind, level, or ahead), for a batch of words at once, and only into children that keep a state alive. Each trie node is
reached once for a word, so accepting nodes are its neighbours without repeats. A task reduces them to their number and
the best form, so a row for each word leaves it.

Words grow with the corpus, so there may be several passes, each with tries of the same bound; a trie holds a stretch of the
alphabet, which most words leave within a few letters.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import erase, written

MIN_LENGTH, MIN_COUNT, DROPPED = 5, 3, 97
#: Letters of a trie's words padded to the longest, words of a trie, bytes broadcast at once (a trie more at most).
TRIE_CELLS, TRIE_WORDS, BROADCAST = 8_000_000, 200_000, 16 << 20
#: Words of a task; of a batch, and its letters.
TASK_WORDS, BATCH_WORDS, BATCH_CELLS = 25_000, 2048, 2_000_000
COUNTED_KEPT, TEXT_STRETCH = 200_000, 1 << 20

LETTERS = "a-zÀ-ÿ"  # in texts whose A-Z are lower-case
BREAK = re.compile(f"[^{LETTERS}]")
#: No edit yet; one edit, with the automaton a letter behind the trie, level with it, or ahead.
EXACT, BEHIND, LEVEL, AHEAD = 1, 2, 4, 8


def variants(doc_id: str, text: str, least: int = MIN_LENGTH) -> Counter:
    """The results of a text's runs of at least ``least`` letters, and how often they occur: a run whose checksum with the
    document's id is divisible by DROPPED has lost a letter."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")
    lowered, counted, at = text.encode("utf-8", "replace").lower().decode(), Counter(), 0
    while at < len(lowered):
        end = BREAK.search(lowered, min(len(lowered), at + TEXT_STRETCH))
        end = end.start() if end else len(lowered)
        counted.update(runs.findall(lowered, at, end))
        at = end
    before, lost = crc32(f"{doc_id}:".encode()), []
    for run in counted:
        h = crc32(run.encode(), before)
        if h % DROPPED == 0:
            lost.append((run, h % len(run)))
    moved = Counter()
    for run, k in lost:
        moved[run[:k] + run[k + 1 :]] += counted.pop(run)
    for run, n in moved.items():
        if len(run) >= least:
            counted[run] += n
    return counted


def count_words(docs: DataFrame, min_length: int, min_count: int, id_col: str, text_col: str) -> DataFrame:
    """word, n of the words with enough letters and occurrences."""

    def counted(batches):
        held: dict[str, int] = {}

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part in batches:
            for doc_id, text in zip(part.column(0), part.column(1)):
                for run, n in variants(doc_id.as_py() or "", text.as_py(), min_length).items():
                    held[run] = held.get(run, 0) + n
                if len(held) >= COUNTED_KEPT:
                    yield batch()
        yield batch()

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter((F.col("n") >= min_count) & (F.length("word") >= min_length))


def _matrix(words: list[bytes], before: int = 0, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Letters (a byte each) of the words, padded with zeros, and the words' lengths."""
    size = np.array([len(w) for w in words])
    width = int(size.max())
    m = np.zeros((len(words), before + width + after), np.uint8)
    m[:, before : before + width] = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return m, size


def plant(words: list[bytes], counts: list[int]) -> bytes:
    """A compact trie of sorted distinct words: nodes level by level, each with its letter, its number of children, whether a
    word ends there; and the counts of the words in the order of their nodes."""
    m, size = _matrix(words)
    differs = m[1:] != m[:-1]
    shared = np.concatenate([[0], differs.argmax(1)])  # letters that a word has in common with the one before
    label, parent, ends, base, last = [np.zeros(1, np.uint8)], [], np.empty(len(words), np.int64), 1, np.zeros(len(words), np.int64)
    for d in range(m.shape[1]):
        fresh = (shared <= d) & (size > d)
        number = base + np.cumsum(fresh) - 1
        label.append(m[fresh, d])
        parent.append(last[fresh])
        ends[size == d + 1] = number[size == d + 1]
        base, last = base + int(fresh.sum()), number
    kids = np.bincount(np.concatenate(parent), minlength=base).astype(np.uint8)
    mark = np.zeros(base, np.uint8)
    mark[ends] = 1
    return b"".join([np.int64(base).tobytes(), np.concatenate(label).tobytes(), kids.tobytes(), mark.tobytes(), np.array(counts, np.int64)[np.argsort(ends)].tobytes()])


class Trie:
    """A compact trie unfolded for search."""

    def __init__(self, blob: bytes):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        self.label, kids, mark = (np.frombuffer(blob, np.uint8, n, 8 + k * n) for k in range(3))
        self.kids = kids.astype(np.int64)
        self.first = 1 + np.cumsum(self.kids) - self.kids
        self.parent = np.concatenate([[0], np.repeat(np.arange(n), self.kids)])
        self.count = np.zeros(n, np.int64)
        self.count[mark == 1] = np.frombuffer(blob, np.int64, -1, 8 + 3 * n)
        self.keys = self.parent[1:] * 256 + self.label[1:]  # ascending, as children follow each other by letter

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The node's child by that letter, 0 if there is none."""
        key = node * 256 + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, 0)

    def spell(self, nodes: np.ndarray) -> list[bytes]:
        """The words that end at ``nodes``."""
        letters, at = [], nodes
        while at.any():
            letters.append(self.label[at])
            at = self.parent[at]
        return [bytes(w[w > 0]) for w in np.array(letters[::-1]).T] if letters else []

    def neighbours(self, m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, nodes of words exactly one edit from them); ``m`` has a zero before the words and two after."""
        word, node, state = np.arange(len(m)), np.zeros(len(m), np.int64), np.full(len(m), EXACT | AHEAD, np.uint8)
        found, d = [], 0
        while len(word):
            behind, level, ahead = (m[word, min(d + k, m.shape[1] - 1)] for k in range(3))
            rest = size[word] - d
            accepts = (self.count[node] > 0) & ((state & BEHIND > 0) & (rest == -1) | (state & LEVEL > 0) & (rest == 0) | (state & AHEAD > 0) & (rest == 1))
            if accepts.any():
                found.append((word[accepts], node[accepts]))
            # without an edit all children go on; after one only those by the letter that a state waits for
            free = np.flatnonzero(state & EXACT)
            n = self.kids[node[free]]
            source = np.repeat(free, n)
            child = np.repeat(self.first[node[free]] - np.cumsum(n) + n, n) + np.arange(len(source))
            bound = state & EXACT == 0
            tries = ((BEHIND, behind, bound), (LEVEL, level, bound & ~((state & BEHIND > 0) & (behind == level))), (AHEAD, ahead, bound & ~((state & BEHIND > 0) & (behind == ahead)) & ~((state & LEVEL > 0) & (level == ahead))))
            sources, children = [source], [child]
            for bit, letter, open_ in tries:
                k = np.flatnonzero(open_ & (state & bit > 0) & (letter > 0))
                at = self.child(node[k], letter[k])
                sources.append(k[at > 0])
                children.append(at[at > 0])
            source, child = np.concatenate(sources), np.concatenate(children)
            letter, old = self.label[child], state[source]
            exact, same = old & EXACT > 0, letter == level[source]
            now = np.where(exact & same, EXACT, 0) | np.where(exact | (old & BEHIND > 0) & (letter == behind[source]), BEHIND, 0)
            now |= np.where(exact & ~same & (rest[source] > 0) | (old & LEVEL > 0) & same, LEVEL, 0)
            now |= np.where((old & AHEAD > 0) & (letter == ahead[source]) | exact & same & (rest[source] > 1), AHEAD, 0)
            alive = now > 0
            word, node, state, d = word[source[alive]], child[alive], now[alive].astype(np.uint8), d + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _batches_of(words: list[bytes]):
    """Places of words of similar length, as many at a time as the bounds allow."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < BATCH_WORDS and (end - at + 1) * (len(words[order[end]]) + 3) <= BATCH_CELLS:
            end += 1
        yield order[at:end]
        at = end


def look_up(words: list[bytes], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """How many of the tries' words are one edit from each word, the greatest count of these, and the first of those with it."""
    near, most, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [None] * len(words)
    for blob in blobs:
        trie = Trie(blob)
        for batch in _batches_of(words):
            word, node = trie.neighbours(*_matrix([words[k] for k in batch], 1, 2))
            if not len(word):
                continue
            near[batch] += np.bincount(word, minlength=len(batch))
            top = np.zeros(len(batch), np.int64)
            np.maximum.at(top, word, trie.count[node])
            leads = trie.count[node] == top[word]
            for k, own in zip(word[leads].tolist(), trie.spell(node[leads])):
                k, n = batch[k], int(top[k])
                if n > most[k] or n == most[k] and own < best[k]:
                    most[k], best[k] = n, own
    return near, most, best


def _tries(words: DataFrame) -> DataFrame:
    """size (bytes), trie: stretches of the words in their order."""

    def build(batches):
        own, counts, width = [], [], 0

        def row():
            blob = plant(own, counts)
            return pa.RecordBatch.from_arrays([pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())], ["size", "trie"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = word.encode("latin-1")
                wider = max(width, len(word))
                if own and (len(own) >= TRIE_WORDS or (len(own) + 1) * wider > TRIE_CELLS):
                    yield row()
                    own, counts, wider = [], [], len(word)
                own.append(word)
                counts.append(n)
                width = wider
        if own:
            yield row()

    return words.select("word", "n").mapInArrow(build, "size long, trie binary")


def _nearest(words: DataFrame, blobs: list[bytes]) -> DataFrame:
    """word, n, n_near, most, best of each word against one broadcast of tries."""
    spread = words.sparkSession.sparkContext.broadcast(blobs)

    def found(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, TASK_WORDS):
                part = batch.slice(i, TASK_WORDS)
                near, most, best = look_up([w.encode("latin-1") for w in part.column(0).to_pylist()], spread.value)
                best = pa.array([b and b.decode("latin-1") for b in best], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near), pa.array(most), best], ["word", "n", "n_near", "most", "best"])

    return words.select("word", "n").mapInArrow(found, "word string, n long, n_near long, most long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms lead to. A form has at least twice its word's count, so paths, halved each time, are short."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variant_groups(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are the results (``variants``) of the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z in lower
    case, with at least ``min_length`` code points and ``min_count`` occurrences. Near are words at edit distance one; ``form`` is the
    near word of the largest count (of these the first in code-point order), if that is at least ``factor`` times the word's, with
    its count ``form_n``, else null; ``root`` is where forms lead to, the word itself if it has none. Null and empty texts have no
    words, a null id is an empty one in checksums, repeated rows count as often as they occur; an empty table gives an empty
    result; other columns are not looked at.
    """
    words = written(count_words(docs, min_length, min_count, id_col, text_col), "words")
    tries = written(_tries(words.repartitionByRange("word").sortWithinPartitions("word")), "tries")
    dealt = words.repartitionByRange(words.count() // TASK_WORDS + 1, "word")
    passes, held, size = [], [], 0
    for row in tries.select("trie").toLocalIterator():
        held.append(bytes(row.trie))
        size += len(held[-1])
        if size >= BROADCAST:
            passes.append(written(_nearest(dealt, held), "near"))
            held, size = [], 0
    if held or not passes:
        passes.append(written(_nearest(dealt, held), "near"))
    near = passes[0]
    for more in passes[1:]:
        near = near.union(more)
    order = F.struct((-F.col("most")).alias("most"), "best")
    joined = near.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), order)).alias("best"))
    has = -F.col("best.most") >= factor * F.col("n")
    forms = written(joined.select("word", "n", "n_near", F.when(has, F.col("best.best")).alias("form"), F.when(has, -F.col("best.most")).alias("form_n")), "forms")
    erase(words, tries, *passes)
    roots = _roots(forms.filter("form is not null"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
