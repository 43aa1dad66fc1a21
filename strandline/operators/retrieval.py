"""Vectors and search: adjacent similarity, semantic groups, top-k by cosine, fixed windows, and retrieval scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import norm, tokens
from strandline.stored import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def semantic_groups(vectors: DataFrame, doc: str, pos: str, vector: str) -> DataFrame:
    """doc, pos, sim (to the one before, 6 places), grp: a new group where the similarity falls under the document's mean
    less its population deviation; a document of under four stays one group."""
    order = Window.partitionBy(doc).orderBy(pos)
    rows = vectors.withColumn("sim", F.round(dot(F.col(vector), F.lag(vector).over(order)), 6)).select(doc, pos, "sim")
    stats = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sim") - F.stddev_pop("sim"), 6).alias("least"))
    cut = ((F.col("n") >= 4) & (F.col("sim") < F.col("least"))).cast("int")
    return rows.join(stats, doc).withColumn("grp", F.coalesce(F.sum(cut).over(order), F.lit(0))).select(doc, pos, "sim", "grp")


def top_k(vectors: DataFrame, query: list[float], id_col: str, vector: str, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows to one query vector by dot product, ties by id; the query is a literal of the plan."""
    score = F.round(dot(F.col(vector), F.array(*map(F.lit, query))), 6)
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Different vectors and queries of a tile at most; its products are made in parts of so many.
ROWS, ASKED, PART = 1 << 16, 1 << 14, 1 << 22


def best_in_tiles(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """qid, vid, score: of each tile the candidates among which are the ``k`` best by dot product of each of its queries. asked: tile, qid, v;
    rows: tile, vid, v; vectors of one length, finite and without nulls.

    A product of matrices in single precision leaves those that its error bound doesn't rule out; these are summed up in
    double precision, term by term as ``dot`` does. All within half a unit of the sixth place of the k-th stay, for its ties.
    """

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"qid": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        q, v = (_rows_of(t.column("v")) for t in (left, right))
        q32, v32 = q.astype(np.float32), v.astype(np.float32)
        qn, vn = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
        slack = (q.shape[1] + 4) * 2.0**-23 * vn.max() * qn + 1e-30
        step, found = max(1, PART // len(v)), []
        for at in range(0, len(q), step):
            s = q32[at : at + step] @ v32.T
            if len(v) > k:
                kth = _kth(s, k) - 2 * slack[at : at + step] - 1.1e-6
                i, j = np.nonzero(s >= kth.astype(np.float32)[:, None] - np.abs(kth).astype(np.float32)[:, None] * np.float32(2.0**-22))
            else:
                i, j = (x.ravel() for x in np.indices(s.shape))
            i += at
            for few in range(0, len(i), PART // 16):
                a, b = i[few : few + PART // 16], j[few : few + PART // 16]
                score = np.zeros(len(a))
                for c in range(q.shape[1]):
                    score += q[a, c] * v[b, c]
                found.append((a, b, score))
        i, j, score = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, np.arange(len(q)))
        kth = score[np.minimum(first + k, np.append(first[1:], len(i))) - 1]
        keep = score >= kth[i] - 1.1e-6
        take = lambda t, name, at: t.column(name).combine_chunks().take(pa.array(at[keep]))
        return pa.table({"qid": take(left, "qid", i), "vid": take(right, "vid", j), "score": score[keep]})

    return asked.groupBy("tile").cogroup(rows.groupBy("tile")).applyInArrow(best, "qid long, vid long, score double")


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _kth(s: np.ndarray, k: int) -> np.ndarray:
    """At most the ``k``-th greatest of each row, and near to it: the k-th of the greatest of a row's parts."""
    width = s.shape[1] // (8 * k)
    if width < 4:
        return np.partition(s, s.shape[1] - k, axis=1)[:, -k]
    parts = s[:, : 8 * k * width].reshape(len(s), 8 * k, width).max(2)
    return np.partition(parts, 7 * k, axis=1)[:, -k]


def distinct_vectors(rows: DataFrame, id_col: str, vector: str, most: int | None, *also: str) -> tuple[DataFrame, DataFrame]:
    """(v, number and ``also``, which a vector determines, of the different vectors of ``rows``; number, id of their rows, of a vector only
    the ``most`` least ids)."""
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), *also)
    if most:
        kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= most).drop("n")
    kept = stored(kept)
    numbered = stored(kept.select("v", *also).distinct().withColumn("number", F.monotonically_increasing_id()))
    return numbered, kept.join(numbered, kept["v"].eqNullSafe(numbered["v"])).select("number", "id")


def plain(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, all of them finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e18)
    return F.coalesce((F.size(vector) == size) & F.forall(vector, good), F.lit(False))


def top_k_each(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, k: int = 5, block: int = 0) -> DataFrame:
    """query_id, ``id_col``, score, rank (from 1): for each row of ``queries`` (query_id, and ``vector``) the ``k`` nearest rows
    by dot product, ties by id.

    Equal vectors have equal scores, so of each different one only the ``k`` least ids are looked at, and equal queries are
    asked once. Different ones are dealt to tiles of at most ROWS vectors and about ASKED (``block``) queries; only candidates leave a
    tile. The work is still all queries with all vectors, as products of matrices. Vectors of another length than most, with nulls or
    without a finite size meet their counterparts one by one.
    """
    known, ids = distinct_vectors(vectors, id_col, vector, k)
    wanted, asking = distinct_vectors(queries, "query_id", vector, None)
    sizes = known.filter("v is not null").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes.size if sizes else 0
    fine, asked = known.filter(plain(F.col("v"), size)), wanted.filter(plain(F.col("v"), size))
    n, m, most = fine.count(), asked.count(), known.sparkSession.sparkContext.defaultParallelism
    down = max(-(-n // ROWS), min(most, -(-n // 2048)), 1)
    across = max(-(-m // (block or ASKED)), 1)
    one = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select(F.col("number").alias("qid"), "v", one("number", across).alias("x"), every(down).alias("y")).select((F.col("x") * down + F.col("y")).alias("tile"), "qid", "v")
    right = fine.select(F.col("number").alias("vid"), "v", one("number", down).alias("y"), every(across).alias("x")).select((F.col("x") * down + F.col("y")).alias("tile"), "vid", "v")
    found = best_in_tiles(left, right, k)
    odd, strange = known.filter(~plain(F.col("v"), size)), wanted.filter(~plain(F.col("v"), size))
    if n < known.count() or m < wanted.count():
        pair = lambda a, b: a.select(F.col("number").alias("qid"), F.col("v").alias("q")).crossJoin(b.select(F.col("number").alias("vid"), "v")).select("qid", "vid", dot(F.col("v"), F.col("q")).alias("score"))
        found = found.union(pair(asked, odd)).union(pair(strange, known))
    return ranked(found, asking, ids, id_col, k)


def ranked(found: DataFrame, asking: DataFrame, ids: DataFrame, id_col: str, k: int) -> DataFrame:
    """The ``k`` best rows of each query from the scores of different ones (qid, vid, score); asking, ids: number, id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id_col)
    rows = found.withColumn("score", F.round("score", 6)).join(ids.select(F.col("number").alias("vid"), F.col("id").alias(id_col)), "vid")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asking.select(F.col("number").alias("qid"), F.col("id").alias("query_id")), "qid").select("query_id", id_col, "score", "rank")


def fixed_windows(docs: DataFrame, size: int = 512, stride: int = 448) -> DataFrame:
    """The baseline: windows of ``size`` tokens, each ``stride`` after the one before: doc_id, window, start, tokens, words."""
    own = docs.select("doc_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.size("t") - 1, F.lit(stride))
    rows = own.select("doc_id", "t", F.posexplode(starts).alias("window", "start"))
    part = F.slice("t", F.col("start") + 1, F.lit(size))
    return rows.select("doc_id", "window", "start", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("content"))


def fixed_windows_of(elements: DataFrame, size: int = 512, stride: int = 448) -> DataFrame:
    """doc_id, window, content: the ``fixed_windows`` of documents whose text is that of their elements (doc_id, pos, text) in order, blank
    lines between. No token spans two elements, so each gives its part to the windows that it is in, and no document is put together."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = elements.select("doc_id", "pos", F.col("text"), F.size(tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    rows = rows.withColumn("end", F.sum("n").over(order)).filter("n > 0").withColumn("begin", F.col("end") - F.col("n"))
    first = F.greatest(F.floor((F.col("begin") - size) / stride) + 1, F.lit(0).cast("long"))
    rows = rows.withColumn("window", F.explode(F.sequence(first, F.floor((F.col("end") - 1) / stride))))
    start = F.col("window") * stride
    low, high = F.greatest(start, "begin"), F.least(start + size, F.col("end"))
    part = F.slice(tokens(F.col("text")), (low - F.col("begin") + 1).cast("int"), (high - low).cast("int"))
    parts = rows.select("doc_id", "window", "pos", F.array_join(part, " ").alias("said"))
    said = F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"])
    return parts.groupBy("doc_id", "window").agg(F.array_join(said, " ").alias("content"))


def overlap_scores(probes: DataFrame, units: DataFrame) -> DataFrame:
    """probe_id, unit_id, score: distinct words that a probe (probe_id, text) and a unit (unit_id, content) share, by an
    equality join on words that are summed up with partial aggregates. Pairs without a shared word are left out."""
    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(F.filter(F.split(norm(F.col(text)), " "), lambda w: w != ""))).alias("word"))
    return words(probes, "probe_id", "text").join(words(units, "unit_id", "content"), "word").groupBy("probe_id", "unit_id").agg(F.count(F.lit(1)).alias("score"))


def retrieval_scores(scored: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """recall_at_k, precision_at_k and mrr over the probes of ``truth`` (probe_id, unit_id): ranks by score, ties by unit."""
    order = Window.partitionBy("probe_id").orderBy(F.desc("score"), "unit_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).join(truth.withColumn("right", F.lit(True)), ["probe_id", "unit_id"])
    own = ranked.groupBy("probe_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("rank"))
    wanted = truth.groupBy("probe_id").agg(F.count(F.lit(1)).alias("wanted")).join(own, "probe_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return wanted.agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg((hits > 0).cast("double")), 6).alias("recall_at_k"), F.round(F.avg(hits / k), 6).alias("precision_at_k"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


#: Units of a block, and probes that meet a block at once, at most in expectation.
UNITS, PROBES = 1 << 16, 200_000


def word_hashes(text: Column) -> Column:
    words = F.array_distinct(F.filter(F.split(norm(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))
    return F.transform(words, lambda w: F.xxhash64(w))


def overlap_retrieval(probes: DataFrame, units: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """``retrieval_scores`` of ``overlap_scores`` without the scores of all pairs: probes (probe_id, text), units (unit_id, content), truth
    (probe_id, unit_id, each pair once).

    A right unit's rank is one more than the number of units that score more, or as much with a lesser id. One that scores t of a
    probe's n words has one of any n - t + 1 of them, so in each block of units only those with one of the rarest are looked at, and
    none where fewer than t of the words occur. Only the ``k`` best right units of a probe matter for its figures. Words are compared by
    64-bit hashes.
    """
    asked = stored(probes.select("probe_id", word_hashes(F.col("text")).alias("p")))
    known = stored(units.select("unit_id", word_hashes(F.col("content")).alias("u")))
    n, m = known.count(), asked.count()
    down, across = max(1, -(-n // UNITS), min(known.sparkSession.sparkContext.defaultParallelism, n // 1000)), max(1, -(-m // PROBES))
    t = F.size(F.array_intersect("p", "u")).cast("long").alias("t")
    right = truth.join(asked, "probe_id").join(known, "unit_id").select("probe_id", "unit_id", t).filter("t > 0")
    nth = F.row_number().over(Window.partitionBy("probe_id").orderBy(F.desc("t"), "unit_id"))
    right = stored(right.withColumn("nth", nth).filter(F.col("nth") <= k))
    ts = right.groupBy("probe_id").agg(F.sort_array(F.collect_list(F.struct("nth", "t", "unit_id"))).alias("r"))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    one = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    tile = (F.col("x") * down + F.col("y")).alias("tile")
    left = asked.join(ts, "probe_id").select("probe_id", "p", F.col("r.t").alias("t"), F.col("r.unit_id").alias("right"), one("probe_id", across).alias("x"), every(down).alias("y")).select(tile, "probe_id", "p", "t", "right")
    own = known.select("unit_id", "u", one("unit_id", down).alias("y"), every(across).alias("x")).select(tile, "unit_id", "u")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"probe_id {kind(asked, 'probe_id')}, unit_id {kind(known, 'unit_id')}, better long"
    better = left.groupBy("tile").cogroup(own.groupBy("tile")).applyInArrow(_better(), schema).groupBy("probe_id", "unit_id").agg(F.sum("better").alias("better"))
    ranked = right.join(better, ["probe_id", "unit_id"], "left").withColumn("rank", F.coalesce("better", F.lit(0)) + 1)
    found = ranked.groupBy("probe_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("rank"))
    return _figures(truth, found, k)


def _better():
    """(probes, units) of a tile: probe_id, unit_id, better: how many of the tile's units are before each of a probe's right ones."""

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = [], [], []
        if left.num_rows and right.num_rows:
            ids = right.column("unit_id").to_numpy()
            u, p = right.column("u").combine_chunks(), left.column("p").combine_chunks()
            words, at = u.flatten().to_numpy(), np.repeat(np.arange(len(u)), np.diff(u.offsets.to_numpy()))
            order = np.argsort(words, kind="stable")
            words, at = words[order], at[order]
            asked, ends = p.flatten().to_numpy(), np.cumsum(np.diff(p.offsets.to_numpy()))
            low, high = np.searchsorted(words, asked, "left"), np.searchsorted(words, asked, "right")
            present = np.add.reduceat(np.append(high > low, 0).astype(np.int64), np.append(0, ends[:-1]))
            least = np.array([x[-1] for x in left.column("t").to_pylist()])  # of the last of the best right ones
            for i in np.flatnonzero(present >= least).tolist():
                begin, end = (ends[i - 1] if i else 0), ends[i]
                rare = begin + np.argsort(high[begin:end] - low[begin:end], kind="stable")
                some = len(rare) - least[i] + 1
                near = np.unique(np.concatenate([at[low[w] : high[w]] for w in rare[:some]]))
                score = np.zeros(len(near), np.int64)
                for w in rare if len(near) else ():
                    having = at[low[w] : high[w]]  # in order, as the sort is stable
                    if len(having):
                        place = np.minimum(np.searchsorted(having, near), len(having) - 1)
                        score += having[place] == near
                for t, unit in zip(left.column("t")[i].as_py(), left.column("right")[i].as_py()):
                    count = int((score > t).sum() + ((score == t) & (ids[near] < unit)).sum())
                    if count:
                        for column, value in zip(rows, (left.column("probe_id")[i].as_py(), unit, count)):
                            column.append(value)
        return pa.table([pa.array(rows[0], left.schema.field("probe_id").type), pa.array(rows[1], right.schema.field("unit_id").type), pa.array(rows[2], pa.int64())], ["probe_id", "unit_id", "better"])

    return counted


def _figures(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    wanted = truth.select("probe_id").distinct().join(found, "probe_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return wanted.agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg((hits > 0).cast("double")), 6).alias("recall_at_k"), F.round(F.avg(hits / k), 6).alias("precision_at_k"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
