"""Removal of repeated passages by suffix automata of reference shards.

A window is ``window`` consecutive words. Documents follow each other by id, so each word has a place in the whole corpus, and a
window goes if the same words start at a smaller place. A document's windows are parted into runs that have the same
occurrence of the least of ``window / 2``-word hashes in common: equal windows have equal anchors, and an anchor that is nowhere
else has no repeated windows.

The text around the first occurrence of each anchor that comes again is the reference, sharded by stretches of SHARD_WORDS
of the corpus. Runs with that anchor elsewhere are streamed through the suffix automaton of its shard: so long as the
matching statistic is a window or more, the state knows the first place of the window's words. A shard is sent to all blocks
of the runs that may match it, and to no others, so that the work follows the repeated text and not the square of the corpus. What
isn't found, as its anchor first occurs between other words, goes through the same once more with the whole window as
its anchor. All decisions compare words; hashes only find candidates.

Shards are bounded by their words, runs are streamed, and shards with over a quarter of a partition's share of them (few by
pigeonhole) are salted.
"""

from __future__ import annotations

from bisect import bisect_right
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import erase, free_names, held, shuffle_partitions, written

WINDOW, SHARD_WORDS, HOT_SHARE, BLOCK_WORDS = 20, 1 << 17, 4, 200_000
WORDS_KEPT = 150_000
#: An odd factor of polynomial hashes modulo 2^64, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Runs without the characters \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "replace").split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each run of windows with one least gram, the leftmost of equal ones."""
    gram = max(1, window // 2)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    own = np.fromiter(map(held("passage-words", _Hashes).__getitem__, words), np.uint64, len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(own * _powers(FACTOR, len(own)), dtype=np.uint64)])
    value = (sums[gram:] - sums[:-gram]) * _powers(INVERSE, len(sums) - gram)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(29)
    at, wide, goal = np.arange(len(value)), 1, window - gram + 1
    while wide < goal:
        shift = min(wide, goal - wide)
        left = value[:-shift] <= value[shift:]
        value, at = np.where(left, value[:-shift], value[shift:]), np.where(left, at[:-shift], at[shift:])
        wide += shift
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return value[starts].view(np.int64), starts.astype(np.int32), np.diff(np.append(starts, len(at))).astype(np.int32)


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, h, n_words, sha (of all words), and the runs of each document."""

    def scanned(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part, rows = batch.slice(i, 200), []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    rows.append((len(words), sha256(b" ".join(words)).hexdigest(), *runs(words, window)))
                arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
                ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
                arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[k] for r in rows]))) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["doc_id", "h", "n_words", "sha", "anchors", "starts", "counts"])

    return docs.mapInArrow(scanned, "doc_id long, h long, n_words long, sha string, anchors array<long>, starts array<int>, counts array<int>")


def _placed(scanned: DataFrame) -> DataFrame:
    """doc_id, h, n_words, sha, copies, base (the words of all documents before, its own among those that have words) of each
    document, by two-level prefix sums."""
    thin = scanned.groupBy("doc_id", "h").agg(F.first("n_words").alias("n_words"), F.first("sha").alias("sha"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("h")]

    def summed(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_words").to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield batch.append_column("part", pa.array(np.full(len(n), part, np.int32))).append_column("before", pa.array(before))

    kinds = "doc_id long, h long, n_words long, sha string, copies long"
    rows = thin.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed, f"{kinds}, part int, before long")
    rows = written(rows, "passage-places")
    at, starts = 0, []
    for r in rows.groupBy("part").agg(F.sum("n_words").alias("n")).orderBy("part").collect():  # as many as partitions
        starts.append((r.part, at))
        at += r.n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    return rows.join(starts, "part").select("doc_id", "h", "n_words", "sha", "copies", (F.col("start") + F.col("before")).alias("base"))


class SuffixAutomaton:
    """Of passages of words, with the first end of the substrings of each state; passages are added by ascending place."""

    def __init__(self):
        self.length, self.link, self.first_end, self.next = [0], [-1], [-1], [{}]
        self.ids: dict[bytes, int] = {}
        self.last, self.size = 0, 0
        self.begins, self.places = [], []

    def add(self, words: list[bytes], place: int) -> None:
        ids = self.ids
        self.begins.append(self.size)
        self.places.append(place)
        for word in words:
            self._extend(ids.setdefault(word, len(ids)))
        self._extend(-len(self.begins))  # between passages, equal to no word

    def _extend(self, c: int) -> None:
        length, link, first_end, following = self.length, self.link, self.first_end, self.next
        own, p = len(length), self.last
        length.append(length[p] + 1)
        first_end.append(self.size)
        following.append({})
        link.append(0)
        while p >= 0 and c not in following[p]:
            following[p][c] = own
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                first_end.append(first_end[q])
                following.append(dict(following[q]))
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[own] = q
        self.last = own
        self.size += 1

    def first_places(self, words: list[bytes], window: int) -> list[int]:
        """For each window of ``words``, the least place where its words are, -1 if they aren't here."""
        ids, length, link, first_end, following = self.ids, self.length, self.link, self.first_end, self.next
        state = matched = 0
        out = []
        for word in words:
            c = ids.get(word)
            if c is None:
                state = matched = 0
            else:
                while state and c not in following[state]:
                    state = link[state]
                    matched = length[state]
                at = following[state].get(c)
                if at is not None:
                    state, matched = at, matched + 1
            if matched >= window:
                while length[link[state]] >= window:
                    state = link[state]
                matched = min(matched, length[state])
                end = first_end[state]
                k = bisect_right(self.begins, end) - 1
                out.append(self.places[k] + end - window + 1 - self.begins[k])
            else:
                out.append(-1)
        return out[window - 1 :]


def _spans(starts: list[int]) -> list[tuple[int, int]]:
    """(first, number) of windows that follow each other."""
    at = np.array(starts, np.int64)
    new = np.flatnonzero(np.append(True, np.diff(at) > 1)) if len(at) else at
    return list(zip(at[new].tolist(), np.diff(np.append(new, len(at))).tolist()))


def _texts_of(docs: DataFrame, places: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` (one row for each base) with doc_id, h and text."""
    keys = marks.join(places.filter("n_words > 0").select("base", F.col("doc_id").alias("id"), F.col("h").alias("key")), "base")
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key"))).drop("id", "key")


def _each_mark(column: pa.ListArray, *fields: str):
    """For each list of structs, the fields' values as arrays."""
    ends, values = column.offsets.to_numpy(), column.values
    arrays = [values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield [x[a:b] for x in arrays]


def _pieces(texts: DataFrame, window: int) -> DataFrame:
    """shard, own, base, start, place, words of the runs in ``marks``, joined where they follow each other in one shard; those of
    the reference also where they overlap."""

    def cut(batches):
        kinds, out = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), []

        def batch_of():
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["shard", "own", "base", "start", "place", "words"])

        for batch in batches:
            bases = batch.column("base").to_pylist()
            for base, text, (starts, counts, shards, owns) in zip(bases, batch.column("text"), _each_mark(batch.column("marks"), "start", "n", "shard", "own")):
                words = words_of(text.as_py())
                group = shards * 2 + owns
                order = np.lexsort((starts, group))
                group, starts, counts = group[order], starts[order], counts[order]
                # where a run doesn't follow the one before, or, of the reference, doesn't overlap it
                gap = np.where(group[1:] & 1, window - 1, 0)
                new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (starts[1:] > starts[:-1] + counts[:-1] + gap)))
                last = np.append(new[1:], len(group)) - 1
                for g, start, end in zip(group[new].tolist(), starts[new].tolist(), (starts[last] + counts[last]).tolist()):
                    out.append((g >> 1, bool(g & 1), base, start, base + start, b" ".join(words[start : end + window - 1])))
                if len(out) >= 2000:
                    yield batch_of()
        yield batch_of()

    return texts.select("base", "text", "marks").mapInArrow(cut, "shard long, own boolean, base long, start int, place long, words binary")


def _matched(pieces: DataFrame, window: int) -> DataFrame:
    """base, start, n of windows whose words are in their shard at a smaller place; with an anchor, those that weren't found."""

    def matched(batches):
        key, automaton, out = None, None, []

        def batch():
            arrays = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, ["base", "start", "n", "anchor"])

        for part in batches:
            columns = [part.column(c) for c in ("shard", "salt", "own", "base", "start", "place", "words")]
            for i in range(part.num_rows):
                shard, salt, own, base, start, place, words = (c[i].as_py() for c in columns)
                if (shard, salt) != key:
                    key, automaton = (shard, salt), SuffixAutomaton()
                words = words.split(b" ")
                if own:
                    automaton.add(words, place)
                    continue
                gone = []
                for k, first in enumerate(automaton.first_places(words, window)):
                    if 0 <= first < place + k:
                        gone.append(start + k)
                    else:
                        out.append((base, start + k, 1, xxhash.xxh64_intdigest(b" ".join(words[k : k + window])) - (1 << 63)))
                out += [(base, a, n, None) for a, n in _spans(gone)]
                if len(out) >= 10_000:
                    yield batch()
        yield batch()

    return pieces.mapInArrow(matched, "base long, start int, n int, anchor long")


def _repeats(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, text of all rows; their places; base, spans of the windows that go)."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer, as documents are ordered by it")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    scanned = written(_scan(source, window), "passage-runs")
    places = _placed(scanned)
    own = scanned.filter(F.size("anchors") > 0).alias("s").join(places.select("doc_id", "h", "base").alias("p"), F.expr("s.doc_id <=> p.doc_id and s.h = p.h"))
    run = F.explode(F.arrays_zip("anchors", "starts", "counts")).alias("r")
    anchors = written(own.select("base", run).select("base", F.col("r.starts").alias("start"), F.col("r.counts").alias("n"), F.col("r.anchors").alias("anchor")), "passage-anchors")
    erase(scanned)
    found, open_ = [], anchors
    while True:
        place = (F.col("base") + F.col("start")).alias("place")
        firsts = open_.select("anchor", place).groupBy("anchor").agg(F.min("place").alias("first"), F.max("place").alias("last"))
        firsts = written(firsts.filter("first < last").select("anchor", "first"), "passage-firsts")
        if firsts.isEmpty():
            erase(firsts)
            break
        linked = open_.join(firsts, "anchor").select("base", "start", "n", F.floor(F.col("first") / SHARD_WORDS).cast("long").alias("shard"), (place == F.col("first")).alias("own"))
        linked = written(linked, "passage-links")
        sizes = linked.filter("not own").groupBy("shard").agg(F.sum(F.col("n") + window - 1).alias("words"))
        total = sizes.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        share = max(BLOCK_WORDS, total // (HOT_SHARE * shuffle_partitions(docs.sparkSession)))
        hot = F.broadcast(sizes.filter(F.col("words") > share).select("shard", F.ceil(F.col("words") / share).cast("int").alias("salts")))  # fewer than HOT_SHARE * partitions
        marks = linked.groupBy("base").agg(F.collect_set(F.struct("start", "n", "shard", "own")).alias("marks"))
        salts = F.coalesce("salts", F.lit(1))
        salt = F.when(F.col("own"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.pmod(F.xxhash64("place"), salts).cast("int")))
        pieces = _pieces(_texts_of(source, places, marks), window).join(hot, "shard", "left").withColumn("salt", F.explode(salt)).drop("salts")
        pieces = pieces.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.desc("own"), "place")
        out = written(_matched(pieces, window), "passage-windows")
        erase(firsts, linked)
        found.append(out)
        open_ = out.filter("anchor is not null")
    erase(anchors)
    gone = None
    for out in found:
        rows = out.filter("anchor is null").select("base", "start", "n")
        gone = rows if gone is None else gone.union(rows)
    if gone is None:
        gone = docs.sparkSession.createDataFrame([], "base long, start int, n int")
    return source, places, gone.groupBy("base").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def _cut(docs: DataFrame, window: int, kept: bool) -> DataFrame:
    """doc_id, h, n_removed, and the kept words joined by one space, or their sha256."""

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, removed, lefts = batch.slice(at, 200), [], []
                for text, (starts, counts) in zip(part.column("text"), _each_mark(part.column("spans"), "start", "n")):
                    words = words_of(text.as_py())
                    stays = np.ones(len(words), bool)
                    for start, end in zip(starts.tolist(), (starts + counts).tolist()):
                        stays[start : end + window - 1] = False
                    left = b" ".join(compress(words, stays.tolist()))
                    removed.append(len(words) - int(stays.sum()))
                    lefts.append(left.decode() if kept else sha256(left).hexdigest())
                arrays = [part.column("doc_id"), part.column("h"), pa.array(removed, pa.int64()), pa.array(lefts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "n_removed", "left"])

    return docs.select("doc_id", "h", "text", "spans").mapInArrow(cut, "doc_id long, h long, n_removed long, left string")


def _with_cut(rows: DataFrame, cut: DataFrame) -> DataFrame:
    marked = cut.select(F.col("doc_id").alias("id"), F.col("h").alias("key"), "n_removed", "left").dropDuplicates(["id", "key"])
    return rows.join(marked, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")), "left")


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space, in UTF-8).

    Words are runs without ASCII white space. A word is removed if a window of ``window`` words that covers it also starts earlier:
    in a document with a smaller id, or higher up in its own; windows are judged on the input. Null, empty and blank texts have no
    words. Rows that repeat an id are documents one after the other, by the hash of their texts; rows that repeat id and text
    are one document and get equal values; rows without an id come last. Ids are integers (else TypeError). An empty table gives
    an empty result; other columns are not looked at.
    """
    source, places, gone = _repeats(docs, window, id_col, text_col)
    cut = _cut(_texts_of(source, places, gone), window, kept=False)
    rows = _with_cut(places.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), cut)
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("left", "sha").alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the texts that lose words as their kept words joined by one space, and all others as they are; a text that loses
    all becomes empty. Columns and rows stay, and odd rows are as in ``repeated_passages``."""
    source, places, gone = _repeats(docs, window, id_col, text_col)
    cut = written(_cut(_texts_of(source, places, gone), window, kept=True), "passage-cuts").dropDuplicates(["doc_id", "h"])
    id_, key, left = free_names(docs, "id", "key", "left")
    marked = cut.select(F.col("doc_id").alias(id_), F.col("h").alias(key), F.col("left").alias(left))
    rows = docs.join(marked, docs[id_col].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text_col]) == F.col(key)), "left")
    return rows.select(*[F.coalesce(F.col(left), docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])
