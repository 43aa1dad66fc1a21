"""Centroid clustering with ball-tree filtering, in exact integers.

Vectors become integers once. Each task puts its vectors, a block at a time, into metric trees: a node has the radius of
its ball, the count of its vectors and their integer sum. The trees are written once; each round reads them with the
centroids broadcast (clusters times components). A ball goes down the tree with the centroids that may be nearest to any
of its members by the triangle inequality; once one is left, the whole ball is that one's, and its count and sum are added
without a look at the members. Leaves with several are decided member by member on integer distances. Tasks add up
their own sums, so a row for each task and cluster is shuffled.

Equal vectors are a ball of radius 0, decided at once however many they are.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import erase, written

#: Vectors of a tree, and of a leaf at most.
BLOCK, LEAF = 4096, 32
#: Components up to this keep squared distances of 64 of them in 64 bits, and those up to NARROW in a double's 53.
LIMIT, NARROW = 1 << 27, 1 << 22


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """id, x (the components' floor(scale * component)) of the vectors with exactly ``dims`` components, all of them finite."""
    x = F.col(vec_col).cast("array<double>")
    fits = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(F.abs(v) * scale < LIMIT, F.lit(False)))
    return vectors.filter(F.coalesce(fits, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))


def grow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows; start, end and parent of each node; squared radius around floor(sum / count); sum). Nodes come
    after their parents; children part a node's rows by the nearer of two far ones."""
    order, queue, radii, sums = np.arange(len(x)), [(0, len(x), -1)], [], []
    for k, (start, end, _) in enumerate(queue):
        at = order[start:end]
        own = x[at]
        total = own.sum(0)
        from_centre = ((own - total // len(own)) ** 2).sum(1)
        radii.append(from_centre.max())
        sums.append(total)
        if end - start > LEAF and radii[-1]:
            one = ((own - own[from_centre.argmax()]) ** 2).sum(1)
            left = one <= ((own - own[one.argmax()]) ** 2).sum(1)
            middle = start + int(left.sum())
            order[start:end] = np.concatenate([at[left], at[~left]])
            queue += [(start, middle, k), (middle, end, k)]
    return order, np.array(queue, np.int32), np.array(radii, np.int64), np.array(sums, np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to those of ``b``."""
    kind = np.float64 if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= NARROW else np.int64
    x, y = a.astype(kind), b.astype(kind)
    return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)


def sift(nodes: np.ndarray, radii: np.ndarray, sums: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """((node, cluster) of the balls that are one cluster's whole, leaves with several possible)."""
    own = np.sort(np.unique(centroids, axis=0, return_index=True)[1])  # of equal centroids the first takes all
    counts = (nodes[:, 1] - nodes[:, 0]).astype(np.int64)
    d2 = squared(sums // counts[:, None], centroids[own])
    d, r = np.sqrt(d2.astype(float)), np.sqrt(radii.astype(float))[:, None]
    possible = d - r <= (d.min(1, keepdims=True) + r) * (1 + 1e-9) + 1e-6
    inner = np.zeros(len(nodes), bool)
    inner[nodes[nodes[:, 2] >= 0, 2]] = True
    whole, leaves, done = [], [], np.zeros(len(nodes), bool)
    for k, parent in enumerate(nodes[:, 2].tolist()):
        if parent >= 0:
            done[k] = done[parent]
            possible[k] &= possible[parent]
        if done[k]:
            continue
        if radii[k] == 0:
            whole.append((k, int(own[d2[k].argmin()])))
        elif possible[k].sum() == 1:
            whole.append((k, int(own[possible[k].argmax()])))
        elif inner[k]:
            continue
        else:
            leaves.append(k)
        done[k] = True
    return whole, leaves


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid, of equally near ones the smallest."""
    return squared(x, centroids).argmin(1)


def _trees(rows: DataFrame, dims: int) -> DataFrame:
    """A row for each tree: ids, vectors (of ``width`` bytes a component) in the tree's order, nodes, radii, sums."""

    def built(ids: list, xs: list) -> pa.RecordBatch:
        ids, x = pa.concat_arrays(ids), np.concatenate(xs)
        order, nodes, radii, sums = grow(x)
        most = int(np.abs(x).max())
        width = 1 if most < 128 else 2 if most < 1 << 15 else 4
        blobs = [x[order].astype(f"<i{width}"), nodes.astype("<i4"), radii.astype("<i8"), sums.astype("<i8")]
        own = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([own, pa.array([width], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["ids", "width", "vectors", "nodes", "radii", "sums"])

    def build(batches):
        ids, xs, n = [], [], 0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for i in range(0, len(x), BLOCK):
                part = x[i : i + BLOCK]
                if n + len(part) > BLOCK:
                    yield built(ids, xs)
                    ids, xs, n = [], [], 0
                ids.append(batch.column(0).slice(i, len(part)))
                xs.append(part)
                n += len(part)
        if n:
            yield built(ids, xs)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(build, f"ids array<{kind}>, width int, vectors binary, nodes binary, radii binary, sums binary")


def _each_tree(batches, dims: int):
    """(ids, vectors, nodes, radii, sums) of each row of batches of trees."""
    for batch in batches:
        for i in range(batch.num_rows):
            width, *blobs = (batch.column(c)[i].as_py() for c in ("width", "vectors", "nodes", "radii", "sums"))
            x, nodes, radii, sums = (np.frombuffer(b, t) for b, t in zip(blobs, (f"<i{width}", "<i4", "<i8", "<i8")))
            yield batch.column("ids")[i].values, x.reshape(-1, dims), nodes.reshape(-1, 3), radii, sums.reshape(-1, dims)


def _totals(trees: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, sum of its vectors) of the clusters that have any."""
    clusters, dims = centroids.shape
    spread = trees.sparkSession.sparkContext.broadcast(centroids)

    def added(batches):
        counts, total, own = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64), spread.value
        for _, x, nodes, radii, sums in _each_tree(batches, dims):
            whole, leaves = sift(nodes, radii, sums, own)
            for k, c in whole:
                counts[c] += nodes[k, 1] - nodes[k, 0]
                total[c] += sums[k]
            if leaves:
                members = np.concatenate([x[nodes[k, 0] : nodes[k, 1]] for k in leaves]).astype(np.int64)
                at = nearest(members, own)
                counts += np.bincount(at, minlength=clusters)
                np.add.at(total, at, members)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    rows = trees.mapInArrow(added, "cluster int, n long, total array<long>")
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    found = rows.groupBy("cluster").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("total")[i]) for i in range(dims)]).alias("total"))
    return [(r.cluster, int(r.n), [int(v) for v in r.total]) for r in found.collect()]  # a row for each cluster


def _assigned(trees: DataFrame, centroids: np.ndarray, id_type: str) -> DataFrame:
    """id, cluster, distance of each vector."""
    spread, dims = trees.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def decided(batches):
        for ids, x, nodes, radii, sums in _each_tree(batches, dims):
            own, x, at = spread.value, x.astype(np.int64), np.zeros(len(x), np.int64)
            whole, leaves = sift(nodes, radii, sums, own)
            for k, c in whole:
                at[nodes[k, 0] : nodes[k, 1]] = c
            for k in leaves:
                at[nodes[k, 0] : nodes[k, 1]] = nearest(x[nodes[k, 0] : nodes[k, 1]], own)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at, pa.int32()), pa.array(((x - own[at]) ** 2).sum(1), pa.int64())], ["id", "cluster", "distance"])

    return trees.mapInArrow(decided, f"id {id_type}, cluster int, distance long")


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose lower-case sha256 of ``<seed>:<id>`` is least, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r.x for r in rows.select("x", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()], np.int64)


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components x become floor(scale * x). Vectors that are null, have not exactly ``dims`` components, or have one that is null,
    not finite or, so scaled, of 2^27 or more have no row. The first centroids are the vectors whose sha256 of ``seed:id`` are
    least (null ids last, of one id the least vector first); if there are fewer vectors than ``clusters``, all of them. Each of
    ``rounds`` rounds gives vectors to the nearest centroid (the smaller number of equally near ones) and moves centroids
    that have any to floor(sum / count); then vectors are assigned once more. Null and repeated ids are vectors like others;
    an empty table gives an empty result; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, dims, scale, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    trees = written(_trees(rows, dims), "ball-trees")
    for _ in range(rounds):
        for c, n, total in _totals(trees, centroids):
            centroids[c] = [v // n for v in total]
    out = written(_assigned(trees, centroids, id_type), "clusters")
    erase(trees)
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    figures = [(c, n, sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    named = F.broadcast(spark.createDataFrame(figures, "cluster int, cluster_inertia long, centroid_sha256 string"))  # a row for each cluster
    whole: Column = F.lit(sum(inertia.values())).cast("long")
    return out.join(named, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", whole.alias("inertia"), "centroid_sha256")
