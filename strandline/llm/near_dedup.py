"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles, and a signature of minwise tokens of that set. Equal sets are one
node from the start. Independent trees branch the nodes: at each level a node goes on by the value of one of its
minwise tokens, chosen by the tree, and with a probability of 1 / threshold - 1 by a second one too, which holds the
chance that a similar pair stays together as paths grow. There are as many trees as a pair of just the threshold needs
to meet in one of them with the probability ``recall``, whatever the level its paths end at.

Tree nodes of at most ``LEAF`` members are compared exhaustively on their signatures. Larger ones branch again, down to
``DEPTH``, or until a node keeps most of its parent's members: then it is a core of documents that share nearly
everything, which further tokens would not part. A core is compared in blocks, all with the same pivots, and members
that don't join its largest component are then compared with all of it, a block of them with a block of members at a time. Where
these are many, as copies of a template that differ in their own words do, only those are compared that share one of their rarer
shingles, or so few words besides the common ones that those may do.

Candidates are confirmed on full sets, at first those of a spanning forest of the likeliest pairs of each leaf or block;
then, where they meet, all between documents that these have not connected. So a large group costs links in proportion to its
rows, never to their square, and no link between two classes is lost that the trees find.
"""

from __future__ import annotations

import math
import random
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import erase, free_names, held, written

#: Eight lanes of a 64-bit word count equal tokens; with under 256 tokens their sum fits a byte.
TOKENS, DEPTH, LEAF = 248, 6, 512
#: The chance of a pair of just the threshold to meet in a tree, over all trees.
RECALL = 0.999
#: A node that keeps this share of its parent's members is a core.
CORE_SHARE = 0.7
#: Candidates have an estimated similarity of the threshold less this: over three standard deviations.
SLACK = 0.08
WORDS_KEPT, ROUNDS = 150_000, 100
#: Nodes that a task connects at once.
OWN_NODES = 500_000
#: Of so many members of a core, chosen by their hash, at least half have what is common in it.
COMMON_OF = 128

_draw = random.Random(20240229)
_FACTORS = [(_draw.getrandbits(64) | 1, _draw.getrandbits(64)) for _ in range(TOKENS)]


def trees_for(recall: float, threshold: float) -> int:
    """How many trees find a pair of similarity ``threshold`` with probability ``recall`` even at the deepest level: a
    path of the pair goes on with the threshold's probability, and a second one is added with 1 / threshold - 1."""
    second, met = 1 / threshold - 1, 1.0
    for _ in range(DEPTH):
        met = 1 - (1 - threshold * met) * (1 - second * threshold * met)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


@cache
def _places(trees: int) -> list[int]:
    """The tokens that the trees branch by, one tree after the other: two for each level."""
    return [p for t in range(trees) for p in random.Random(t).sample(range(TOKENS), 2 * DEPTH)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h



def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; of a shorter text the whole sequence is one."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z, splits at \x20 \x09-\x0D
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("shingle-words", _Words).__getitem__, own), np.uint64, len(own))
    size = min(words, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + len(s)]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(s ^ (s >> np.uint64(31)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TOKENS minwise tokens (32 bits) of each set; none may be empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), TOKENS), np.uint32)
    for k, (a, b) in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(x * np.uint64(a) + np.uint64(b) >> np.uint64(32), starts)
    return out


def sketch(docs: DataFrame, words: int, trees: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (of the text), n_shingles, content (128 bits of the set; null if empty), path (the trees' tokens, 32 bits each),
    bits (8 of each token)."""
    places = _places(trees)

    def sketched(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = [shingles(t, words) for t in part.column(2).to_pylist()]
                full = [s for s in sets if len(s)]
                tokens = iter(signatures(full)) if full else iter(())
                rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, next(tokens) if len(s) else None) for s in sets]
                arrays = [part.column(0), part.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
                arrays.append(pa.array([None if r[2] is None else r[2][places].astype("<u4").tobytes() for r in rows], pa.binary()))
                arrays.append(pa.array([None if r[2] is None else r[2].astype("u1").tobytes() for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "n_shingles", "content", "path", "bits"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"xxhash64(`{text_col}`) h", f"`{text_col}` text")
    return rows.mapInArrow(sketched, "doc_id long, h long, n_shingles long, content binary, path binary, bits binary")


def _branch(rows: DataFrame, level: int, second: float) -> DataFrame:
    """node, tree, path, key of the next level, before (the members of the node so far); ``key`` is the way so far."""
    place = lambda j: F.col("tree") * (2 * DEPTH) + 2 * level + j
    step = lambda j: F.xxhash64("key", F.lit(j), F.substring("path", place(j) * 4 + 1, F.lit(4)))
    also = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1000)) < int(1000 * second)
    keys = F.when(also, F.array(step(0), step(1))).otherwise(F.array(step(0)))
    return rows.select("node", "tree", *(["path"] if level else []), "before", F.explode(keys).alias("key"))


def _tree_nodes(nodes: DataFrame, trees: int, second: float) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(leaves, cores, the tables they are read from): key, node, n for each member of the trees' last nodes of two members
    and more."""
    live = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "path")
    live = live.select("node", "tree", "path", F.xxhash64("tree").alias("key"), F.lit(None).cast("long").alias("before"))
    leaves, cores, tables = [], [], []
    for level in range(DEPTH):
        rows = _branch(live, level, second)
        several = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "keys")  # written, so that the join can part a large key
        rows = written(rows.join(several, "key"), f"level{level}")
        erase(several)
        tables.append(rows)
        large = F.col("n") > LEAF
        stuck = large & (F.lit(level == DEPTH - 1) | F.coalesce(F.col("n") >= CORE_SHARE * F.col("before"), F.lit(False)))
        leaves.append(rows.filter(~large).select("key", "node", "n"))
        cores.append(rows.filter(stuck).select("key", "node", "n"))
        live = rows.filter(large & ~stuck)
        if live.isEmpty():
            return _once(leaves, tables), _union(cores) if level or DEPTH == 1 else None, tables
        live = live.withColumn("before", F.col("n")).drop("n")
        if level == 0:
            live = _of_nodes(live.select("node", "tree", "key", "before"), nodes.select("node", "path"))
    return _once(leaves, tables), _union(cores), tables


def _once(groups: list[DataFrame], tables: list[DataFrame]) -> DataFrame:
    """The union of ``groups`` (key, node, n) by way of a table that joins ``tables``: of those with the same members, which several trees
    find, the one with the least key."""
    every = _union(groups)
    sums = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in range(2)]
    same = every.groupBy("key", "n").agg(*sums).groupBy("n", "sum0", "sum1").agg(F.min("key").alias("key"))
    tables.append(written(every.join(same.select("key"), "key"), "leaves"))  # a semi join would be one for each level
    return tables[-1]


def _of_nodes(places: DataFrame, *tables: DataFrame) -> DataFrame:
    """``places`` (node, and where it is) with what ``tables`` have of each node, which meets them once, however many places it has."""
    rows = places.groupBy("node").agg(F.collect_list(F.struct(*[c for c in places.columns if c != "node"])).alias("places"))
    for table in tables:
        rows = rows.join(table, "node")
    own = [c for c in rows.columns if c != "places"]
    return rows.select(*own, F.explode("places").alias("place")).select(*own, "place.*")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _equal(m: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many tokens each of the rows has in common with ``row``."""
    lanes = (m == row).view(np.uint64).sum(1)
    return (lanes * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)


def _matrix(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), TOKENS)


def spanning(m: np.ndarray, least: int, pivots: int = 0) -> list[tuple[int, int]]:
    """A forest of the likeliest pairs with at least ``least`` equal tokens that connects what such pairs connect; the
    first ``pivots`` rows count as connected from the start."""
    if len(m) == 2 and not pivots:
        return [(0, 1)] if int((m[0] == m[1]).sum()) >= least else []
    left, at = m.copy(), np.arange(len(m))
    count = len(m)
    best, parent = np.full(len(m), -1), np.zeros(len(m), np.int64)

    def take(k: int) -> int:
        """Moves the row at ``k`` out of those that are left."""
        nonlocal count
        j, count = int(at[k]), count - 1
        for x in (left, at, best, parent):
            x[k] = x[count]
        return j

    def reach(j: int) -> None:
        same = _equal(left[:count], m[j])
        nearer = same > best[:count]
        best[:count][nearer] = same[nearer]
        parent[:count][nearer] = j

    for j in range(pivots):
        take(int(np.flatnonzero(at[:count] == j)[0]))
    for j in range(pivots):
        reach(j)
    edges = []
    while count:
        k = int(best[:count].argmax())
        if best[k] >= least:
            edges.append((int(parent[k]), int(at[k])))
        reach(take(k))
    return edges


def _each_key(batches, names: tuple[str, ...]):
    """(key, its rows as lists by name) from batches that are sorted by key."""
    key, own = None, {}
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *names))):
            if k != key or not own:
                if own:
                    yield key, own
                key, own = k, {c: [] for c in names}
            for c, v in zip(names, row):
                own[c].append(v)
    if own:
        yield key, own


def _pair_batches(pairs):
    """Batches of the pairs (a, b), the least first."""
    out = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([f(p) for p in out], pa.int64()) for f in (min, max)], ["a", "b"])

    for pair in pairs:
        out.append(pair)
        if len(out) == 10_000:
            yield batch()
            out.clear()
    yield batch()


def _forest_pairs(rows: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of a spanning forest of each key's members; rows: key, node, bits, pivot."""
    least = math.ceil(cutoff * TOKENS)

    def pairs(batches):
        for _, own in _each_key(batches, ("node", "bits", "pivot")):
            if len(own["node"]) > 1:
                order = sorted(range(len(own["node"])), key=lambda i: not own["pivot"][i])
                nodes = [own["node"][i] for i in order]
                m = _matrix([own["bits"][i] for i in order])
                yield from ((nodes[i], nodes[j]) for i, j in spanning(m, least, sum(own["pivot"])))

    return rows.select("key", "node", "bits", "pivot").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: _pair_batches(pairs(b)), "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _open_links(rows: DataFrame, cutoff: float, words: int, percent: int) -> DataFrame:
    """Links between different components, each looked for in the least of the ``groups`` that both ends are in; rows: key,
    node, bits, text, comp, group, groups, side (0: compared with all of the key, 1: with those of side 2 only, 2: with those
    of side 1), odd (whether it is outside of its core's largest component).

    Candidates are compared on their full sets at once, so that only links leave the task; what a link connects is one
    component from then on.
    """
    least = math.ceil(cutoff * TOKENS)
    names = ("node", "bits", "text", "comp", "group", "groups", "side", "odd")

    def links(batches):
        for _, own in _each_key(batches, names):
            comps = np.unique(np.array(own["comp"], np.int64), return_inverse=True)[1]
            if comps.max() == 0:
                continue
            nodes, side, odd, sets = own["node"], np.array(own["side"]), own["odd"], {}
            m, groups = _matrix(own["bits"]), [frozenset(g) for g in own["groups"]]

            def full(i):
                if i not in sets:
                    sets[i] = shingles(own["text"][i], words)
                return sets[i]

            among = np.flatnonzero(comps != np.bincount(comps).argmax()) if side[0] == 0 else np.flatnonzero(side == 2)
            seen = np.zeros(len(nodes), bool)
            for i in among.tolist():
                seen[i] = True
                others = np.flatnonzero((comps != comps[i]) & (~seen if side[i] == 0 else side == 1))
                same = _equal(m[others], m[i])
                for k in others[np.argsort(-same, kind="stable")[: np.count_nonzero(same >= least)]].tolist():
                    once = side[i] == 0 or not odd[k] or nodes[i] < nodes[k]  # a pair of odd ones meets twice
                    if once and comps[i] != comps[k] and min(groups[i] & groups[k]) == own["group"][i] and linked(full(i), full(k), percent):
                        comps[comps == comps[k]] = comps[i]
                        yield nodes[i], nodes[k]

    return rows.select("key", *names).repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: _pair_batches(links(b)), "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def confirmed(batches):
        last = None, None
        for batch in batches:
            kept = []
            for a, b, ta, tb in zip(*(batch.column(k) for k in range(4))):
                a = a.as_py()
                x = last[1] if last[0] == a else shingles(ta.as_py(), words)
                last = a, x
                y = shingles(tb.as_py(), words)
                kept.append(linked(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(confirmed, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node that can be reached) for each node with an edge (a, b)."""
    stars = _stars(edges)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _own_stars(batches):
    """What the edges (a, b) of a task connect, as edges of each node with the least one; so many nodes at a time as fit."""
    top: dict[int, int] = {}

    def least(x: int) -> int:
        while x in top:
            top[x] = x = top.get(top[x], top[x])
        return x

    def stars():
        return pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array([least(x) for x in list(top)], pa.int64())], ["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = least(a), least(b)
            if x != y:
                top[max(x, y)] = min(x, y)
        if len(top) > OWN_NODES:
            yield stars()
            top.clear()
    yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """u, v: each node with an edge (a, b) but the least of its component, and that least one, by alternating stars.

    Each task first connects the edges that it reads. Then a round makes two passes over what is left and as good as halves the
    longest path; each is a written table. The first pass of a round changes nothing once all smaller ends are the least of their
    component as far as their edges tell; if no node has two of them either, that is the result.
    """
    sums = lambda table: table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = written(edges.select("a", "b").mapInArrow(_own_stars, "u long, v long"), "edges")
    mark = None
    for _ in range(ROUNDS):
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large")  # as it is read twice
        if mark is not None and sums(large) == mark and large.groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y")).filter("x != y").isEmpty():
            erase(large)
            return now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to = lambda c: F.struct(F.col(c).alias("u"), F.col("m").alias("v"))
        small = large.join(least, "u").select(F.explode(F.array(to("v"), to("u"))).alias("e")).select("e.u", "e.v").filter("u != v")
        before, now = now, written(small.distinct(), "edges")
        erase(before, large)
        mark = sums(now)
    raise RuntimeError(f"components have not settled in {ROUNDS} rounds")


def _classes(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n_shingles, content of all rows; of each content: low, the least row (no id, doc_id, h) of its class)."""
    threshold = percent / 100
    cutoff, second, trees = threshold - SLACK, 1 / threshold - 1, trees_for(recall, threshold)
    sketches = written(sketch(docs, words, trees, id_col, text_col), "sketches")
    low = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h")
    nodes = sketches.filter("content is not null").groupBy("content").agg(F.min(low).alias("low"), F.first("path").alias("path"), F.first("bits").alias("bits"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, as it is written
    rows = written(sketches.select("doc_id", "h", "n_shingles", "content"), "rows")
    erase(sketches)
    leaves, cores, tables = _tree_nodes(nodes, trees, second)
    plain_bits = nodes.select("node", "bits")

    whole = leaves.select("key", "node", F.lit(False).alias("pivot"))
    if cores is not None:  # blocks of a leaf, a quarter of which are the same pivots; these have a block of their own too
        pivots = LEAF // 4
        count = F.ceil(F.col("n") / (LEAF - pivots)).cast("int")
        pivot = F.pmod(F.xxhash64("node", F.lit(2)), F.ceil(F.col("n") / pivots)) == 0
        block = F.pmod(F.xxhash64("node"), count).cast("int")
        dealt = cores.select("key", "node", pivot.alias("pivot"), F.explode(F.when(pivot, F.sequence(F.lit(-1), count - 1)).otherwise(F.array(block))).alias("block"))
        whole = whole.union(dealt.select(F.xxhash64("key", "block"), "node", F.col("pivot") & (F.col("block") >= 0)))
    first = written(_forest_pairs(_of_nodes(whole, plain_bits), cutoff).distinct(), "forest")
    needed = first.select(F.explode(F.array("a", "b")).alias("node"))
    needed = written((needed.union(cores.select("node")) if cores is not None else needed).distinct(), "needed")
    of = nodes.select("node", "low.doc_id", "low.h").join(needed, "node", "left_semi")
    source = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"xxhash64(`{text_col}`) h", f"`{text_col}` text")
    texts = source.alias("s").join(of.alias("o"), F.expr("s.doc_id <=> o.doc_id and s.h = o.h")).select("node", "text")
    texts = written(texts.dropDuplicates(["node"]), "texts")
    links = written(_confirm(first, texts, words, percent), "links")
    stars = _stars(links)
    comps = stars.select(F.col("u").alias("node"), F.col("v").alias("comp"))

    # What the forests have not connected: links between components. Alone, a node is its own component.
    known = written(needed.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "known")
    inside, close, parts = None, None, [known]
    if cores is not None:
        inside = written(_of_nodes(cores.select("key", "node"), known).select("key", "node", "comp"), "cores")
        parts.append(inside)
        many = written(_mains(inside).filter(F.col("odds") > LEAF).select("key"), "open-cores")  # others are compared with their few odd ones
        parts.append(many)
        if not many.isEmpty():
            opened = written(inside.join(many, "key", "left_semi").select("key", "node"), "opened")
            small, plain = _by_rare_shingles(written(_merged(opened), "merged-cores"), texts, words, percent)
            inside = inside.join(many, "key", "left_anti").select("key", "node", "comp").union(plain.join(known, "node").select("key", "node", "comp"))
            groups = _mixed(_of_nodes(small, known)).select("key", "node", "comp")
            near = _close_pairs(_of_nodes(groups, plain_bits).select("key", "node", "bits", "comp"), cutoff)
            close = written(_confirm(written(near.distinct(), "close"), texts, words, percent), "close-links")
            erase(opened)
    rest = written(_open_links(_open_groups(leaves, inside, known, plain_bits, texts), cutoff, words, percent), "rest")
    if close is not None:
        rest = rest.union(close)
    if not rest.isEmpty():
        comps = _stars(stars.toDF("a", "b").union(rest)).toDF("node", "comp")
    own = nodes.select("node", "content", "low").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = own.groupBy("comp").agg(F.min("low").alias("least"))
    named = written(own.join(least, "comp").select("content", F.col("least").alias("low")), "classes")
    erase(*tables, *parts, nodes, first, needed, texts, links, rest)
    return rows, named


def _mixed(rows: DataFrame) -> DataFrame:
    """The ``rows`` (key, comp and others) of keys with several components; a key has LEAF rows at most."""
    of = Window.partitionBy("key")
    return rows.withColumns({"x": F.min("comp").over(of), "y": F.max("comp").over(of)}).filter("x != y").drop("x", "y")


def _open_groups(leaves: DataFrame, inside: DataFrame | None, known: DataFrame, bits: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of leaves with several components, and those of cores (``inside``: key, node, comp) by blocks, for ``_open_links``.
    Bits and texts are joined once a member, before it is dealt to blocks."""
    none = F.lit(0)
    every = _mixed(_of_nodes(leaves.select("key", "node"), known))  # of a leaf, those with a candidate are in the forest
    rows = every.select("key", "node", "comp", F.lit(False).alias("odd"), none.alias("blocks"), none.alias("odds"))
    if inside is not None:
        half = LEAF // 2
        parts = lambda n: F.ceil(F.col(n) / half).cast("int").alias(n if n == "odds" else "blocks")
        rows = rows.union(inside.join(_mains(inside), "key").select("key", "node", "comp", (F.col("comp") != F.col("main")).alias("odd"), parts("size"), parts("odds")))
    own = rows.groupBy("node", "comp").agg(F.collect_list(F.struct("key", "odd", "blocks", "odds")).alias("places"))
    own = own.join(bits, "node").join(texts, "node").select("node", "comp", "bits", "text", F.col("places.key").alias("groups"), F.explode("places").alias("at"))
    own = own.select("node", "comp", "bits", "text", "groups", F.col("at.key").alias("group"), "at.odd", "at.blocks", "at.odds")
    place = lambda block, against, side: F.struct(F.xxhash64("group", block, against).alias("key"), F.lit(side).alias("side"))
    one = lambda n, *salt: F.pmod(F.xxhash64("node", *salt), F.greatest(n, F.lit(1))).cast("int")
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), f)
    member = upto("odds", lambda k: place(one("blocks"), k, 1))
    other = upto("blocks", lambda k: place(k, one("odds", F.lit(1)), 2))
    alone = F.array(F.struct(F.col("group").alias("key"), none.alias("side")))
    places = F.when(F.col("odds") == 0, alone).when(F.col("odd"), F.concat(member, other)).otherwise(member)
    return own.withColumn("place", F.explode(places)).select("place.key", "node", "comp", "bits", "text", "group", "groups", "place.side", "odd")


def _mains(inside: DataFrame) -> DataFrame:
    """key, main (the component that most of a core's members are in), size, odds (members outside of it) of the cores that have any."""
    sizes = inside.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("own"))
    main = sizes.groupBy("key").agg(F.max_by("comp", F.struct("own", "comp")).alias("main"), F.sum("own").alias("size"), F.max("own").alias("most"))
    return main.select("key", "main", "size", (F.col("size") - F.col("most")).alias("odds")).filter("odds > 0")


def _merged(cores: DataFrame) -> DataFrame:
    """``cores`` (key, node) under the least core that any of their members is in, so that a member of cores of the same documents counts
    once and not for each tree. Members of a core stay together."""
    cores = cores.select("key", "node")
    least = cores.groupBy("node").agg(F.min("key").alias("least"))
    named = cores.join(least, "node").groupBy("key").agg(F.min("least").alias("least"))
    return cores.join(named, "key").select(F.col("least").alias("key"), "node").distinct()


def _by_rare_shingles(cores: DataFrame, texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(small groups, plain members) of ``cores`` (key, node), as key, node: two members that are linked share a group, or are plain in
    one core.

    Common are a core's shingles that at least half of COMMON_OF of its members have; which these are only says how much is left to
    do. Of two linked members with sizes a and b, and at most c common shingles in either, 100 * shared >= percent * union asks for
    more than c shared ones if c * (100 + percent) < percent * (a + b): then they share another shingle, and one that at most LEAF
    members have makes a small group. Others make cores of their own, parted in the same way. Plain is a member whose common
    shingles alone may do for the core's smallest set.
    """

    def shingled(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = [shingles(t, words).view(np.int64) for t in part.column("text").to_pylist()]
                yield _set_batch(part.column("key"), sets)

    def rarer(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part, sets, sizes = batch.slice(i, 200), [], []
                for text, common in zip(part.column("text").to_pylist(), part.column("common")):
                    own = shingles(text, words).view(np.int64)
                    sizes.append(len(own))
                    common = np.array(common.values if common.is_valid else [], np.int64)
                    sets.append(own[~np.isin(own, common)])
                out = _set_batch(part.column("key"), sets)
                yield pa.RecordBatch.from_arrays([*out.columns, part.column("node"), pa.array(sizes, pa.int64())], ["key", "shingles", "node", "n"])

    small, plain, used = [], [], []
    while True:
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
        some = cores.withColumn("nth", nth).filter(F.col("nth") <= COMMON_OF).join(texts, "node").select("key", "text")
        counts = some.mapInArrow(shingled, "key long, shingles array<long>").select("key", F.explode("shingles").alias("shingle")).groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("having"))
        sizes = cores.groupBy("key").agg(F.least(F.count(F.lit(1)), F.lit(COMMON_OF)).alias("of"))
        common = counts.join(sizes, "key").filter("having * 2 >= of").groupBy("key").agg(F.collect_list("shingle").alias("common"))  # of two average sets at most
        rest = cores.join(texts, "node").join(common, "key", "left").select("key", "node", "text", "common")
        rows = written(rest.mapInArrow(rarer, "key long, shingles array<long>, node long, n long").withColumn("c", F.col("n") - F.size("shingles")), "rarer-shingles")
        least = rows.groupBy("key").agg(F.min("n").alias("least"))
        plain.append(written(rows.join(least, "key").filter(F.col("c") * (100 + percent) >= percent * (F.col("n") + F.col("least"))).select("key", "node"), "plain"))
        apart = rows.select("key", "node", F.explode("shingles").alias("shingle")).select(F.xxhash64("key", "shingle").alias("key"), "node")
        having = apart.groupBy("key").agg(F.count(F.lit(1)).alias("having"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).filter("having > 1")
        having = written(having.groupBy("having", "sum").agg(F.min("key").alias("key")), "having")  # shingles that the same members have are one
        of = lambda some: apart.join(having.filter(some).select("key"), "key", "left_semi")
        small.append(written(of(F.col("having") <= LEAF), "rare"))
        cores = written(of(F.col("having") > LEAF), "inner-cores")
        erase(rows, having)
        used.append(cores)
        if cores.isEmpty():
            erase(*used)
            return _union(small), _union(plain)


def _set_batch(keys: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets), pa.int64()))], ["key", "shingles"])


def _close_pairs(rows: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (a, b) of each key's members (key, node, bits, comp) of different components, with signatures as near as ``cutoff``."""
    least = math.ceil(cutoff * TOKENS)

    def pairs(batches):
        for _, own in _each_key(batches, ("node", "bits", "comp")):
            m, comps, nodes = _matrix(own["bits"]), np.array(own["comp"]), own["node"]
            for i in range(len(nodes) - 1):
                near = (_equal(m[i + 1 :], m[i]) >= least) & (comps[i + 1 :] != comps[i])
                yield from ((nodes[i], nodes[i + 1 + k]) for k in np.flatnonzero(near).tolist())

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda b: _pair_batches(pairs(b)), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * |A & B| >= percent * |A | B| for their sets of ``words``-word shingles, found by
    the trees and confirmed on the full sets; ``component_id`` is the smallest id that can be reached over links,
    ``kept`` whether it is the row's own. Words are runs without ASCII white space, A-Z in lower case. A text of fewer
    words is one shingle; null and blank texts have none and are linked with nothing. Rows that repeat an id count as
    rows; a null id never names a component of others. Empty table, empty result; other columns are not looked at.
    """
    rows, named = _classes(docs, words, percent, id_col, text_col, recall)
    out = rows.select("doc_id", "n_shingles", "content").join(named.select("content", F.col("low.doc_id").alias("least")), "content", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, that with the least id, and all without words.

    A row with a null id stays only if its class has no other; of rows that repeat the class's least id the one with the
    least hash of its text stays, of equal rows one. Empty table, empty result; all columns are carried along.
    """
    rows, named = _classes(docs, words, percent, id_col, text_col, recall)
    rows = rows.filter("content is not null").groupBy("doc_id", "h", "content").agg(F.count(F.lit(1)).alias("copies")).join(named, "content")
    same = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("h") == F.col("low.h"))
    id_, h, goes, nth = free_names(docs, "id", "h", "goes", "first")
    marks = rows.select(F.col("doc_id").alias(id_), F.col("h").alias(h), (~same).alias(goes), "copies").filter(F.col(goes) | (F.col("copies") > 1))
    marks = written(marks.select(id_, h, goes), "goes")
    joined = docs.join(marks, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(h)), "left")
    single = joined.filter(F.col(goes).isNull()).select(*docs.columns)
    if marks.filter(~F.col(goes)).isEmpty():
        return single
    first = F.row_number().over(Window.partitionBy(id_, h).orderBy(F.lit(1)))
    twice = joined.filter(~F.col(goes)).withColumn(nth, first).filter(F.col(nth) == 1)
    return single.union(twice.select(*docs.columns))
