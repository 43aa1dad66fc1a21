"""Resharding by minimum-cost flow: from the sizes of the shards there are and the capacities of the new ones, the
block transfers that move the fewest bytes, then the new shards' files, written anew where they change.

The flow is solved on the driver over shards only, by potentials and blocking flows; where all moves cost the same, they go
through one hub, so that arcs grow with the shards and not with their pairs. Rows are placed by two-level prefix sums: blocks
(old shard, size class, hash bucket) of a bounded number of rows get their place in the old shard, rows theirs in the block. A
shard keeps the head of its order, which has the large rows, and sends from its tail, so transfers are cut between small rows.

Rows are dealt once to be written, by old shard and bucket, where their number in the block gives shard and slot; a task writes
the few shards that its block goes to.
"""

from __future__ import annotations

from heapq import heappop, heappush
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from strandline.llm.shared import erase, free_names, written

ROWS_A_BLOCK, BYTES_A_BLOCK = 20_000, 32 << 20
OVERHEAD = 16
BLOCK = ["old_shard", "size_class", "bucket"]


def in_block(size: str, doc_id: str, crc: str) -> list[Column]:
    """The order of a block's rows."""
    return [F.desc(size), F.asc(doc_id), F.asc(crc)]




def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The units on each of ``arcs`` (from, to, capacity, cost of 0 or more) of a largest flow, of these one of least cost.

    Shortest paths by reduced costs give potentials; blocking flows then fill all paths of that length, level by level.
    """
    to, left, price, out = [], [], [], [[] for _ in range(nodes)]
    for u, v, capacity, cost in arcs:
        for a, b, room, c in ((u, v, capacity, cost), (v, u, 0, -cost)):  # an arc and what takes it back, at e and e ^ 1
            out[a].append(len(to))
            to.append(b)
            left.append(room)
            price.append(c)
    potential = [0] * nodes

    def distances() -> list[float]:
        dist, heap, done = [float("inf")] * nodes, [(0, source)], [False] * nodes
        dist[source] = 0
        while heap:
            d, u = heappop(heap)
            if done[u]:
                continue
            done[u] = True
            for e in out[u]:
                if left[e] and not done[to[e]] and (far := d + price[e] + potential[u] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]] = far
                    heappush(heap, (far, to[e]))
        return dist

    def tight(e: int) -> bool:
        return left[e] > 0 and price[e] + potential[to[e ^ 1]] == potential[to[e]]

    def levels() -> list[int]:
        level, queue = [-1] * nodes, [source]
        level[source] = 0
        for u in queue:
            for e in out[u]:
                if level[to[e]] < 0 and tight(e):
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        return level

    def fill(level: list[int]) -> None:
        at, path, u = [0] * nodes, [], source
        while True:
            if u == sink:
                amount = min(left[e] for e in path)
                for e in path:
                    left[e] -= amount
                    left[e ^ 1] += amount
                k = next(k for k, e in enumerate(path) if not left[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[u] < len(out[u]) and not (level[to[out[u][at[u]]]] == level[u] + 1 and tight(out[u][at[u]])):
                at[u] += 1
            if at[u] < len(out[u]):
                path.append(out[u][at[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                at[u] += 1
            else:
                return

    while (dist := distances())[sink] < float("inf"):
        for v in range(nodes):
            potential[v] += min(dist[v], dist[sink])
        while (level := levels())[sink] >= 0:
            fill(level)
    return left[1::2]


def fewest_moves(supply: list[int], capacity: list[int], cost=None) -> list[dict[int, int]]:
    """flow[i][j]: units from old shard i to new shard j of least total cost (default: 0 to stay in place, else 1).

    Capacities must sum to at least the supply.
    """
    m, n = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the rows")
    hub, source, sink = m + n, m + n + 1, m + n + 2
    arcs = [(source, i, s, 0) for i, s in enumerate(supply)] + [(m + j, sink, c, 0) for j, c in enumerate(capacity)]
    ends = len(arcs)
    if cost is None:
        arcs += [(i, m + i, supply[i], 0) for i in range(min(m, n))] + [(i, hub, s, 1) for i, s in enumerate(supply)] + [(hub, m + j, c, 0) for j, c in enumerate(capacity)]
    else:
        arcs += [(i, m + j, s, cost(i, j)) for i, s in enumerate(supply) for j in range(n)]
    units, flow, sent, room = min_cost_flow(m + n + 3, arcs, source, sink), [{} for _ in range(m)], [], []
    for (u, v, *_), amount in list(zip(arcs, units))[ends:]:
        if not amount:
            continue
        if v == hub:
            sent.append([u, amount])
        elif u == hub:
            room.append([v - m, amount])
        else:
            flow[u][v - m] = flow[u].get(v - m, 0) + amount
    while sent:  # what goes into the hub comes out of it, in any order
        amount = min(sent[-1][1], room[-1][1])
        (i, _), (j, _) = sent[-1], room[-1]
        flow[i][j] = flow[i].get(j, 0) + amount
        for stack in (sent, room):
            stack[-1][1] -= amount
            if not stack[-1][1]:
                stack.pop()
    return flow


def even_capacity(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _sized(docs: DataFrame, id_col: str, text_col: str, old: Column, buckets: int) -> list[Column]:
    """doc_id, size, text_crc32, old_shard, size_class, bucket of a row, to be selected."""
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    size, crc = (F.octet_length(body) + OVERHEAD).cast("long"), F.crc32(body)
    bucket = F.pmod(F.xxhash64(id_col, crc, F.lit(1)), F.lit(buckets)).cast("int")
    return [F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), old.alias("old_shard"), F.floor(F.log2(size)).cast("int").alias("size_class"), bucket.alias("bucket")]


class Placement(NamedTuple):
    """rows: doc_id, size, text_crc32, old_shard, size_class, bucket, row (its number in the block, from 1), shard. parts: for each
    shard and block, the first row and number of rows that go there, and shift (slot less row). buckets: of an old shard."""

    rows: DataFrame
    parts: DataFrame
    buckets: int


def _old_of(old_shard, id_col: str, text_col: str, old_shards: int) -> Column:
    return old_shard if old_shard is not None else F.pmod(F.xxhash64(id_col, text_col), F.lit(old_shards)).cast("int")


def place(docs: DataFrame, new_shards: int, old_shards: int, id_col: str = "doc_id", text_col: str = "text", old_shard=None, cost=None) -> Placement:
    """Where each row goes (see ``reshard``); ``cost``: of a byte from an old to a new shard (default: 1 between different ones)."""
    spark = docs.sparkSession
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    buckets = max(n // (old_shards * ROWS_A_BLOCK), total // (old_shards * BYTES_A_BLOCK)) + 1
    rows = written(docs.select(*_sized(docs, id_col, text_col, _old_of(old_shard, id_col, text_col, old_shards), buckets)), "reshard-sizes")

    blocks = rows.groupBy(*BLOCK).agg(F.sum("size").alias("bytes"))
    supply = [0] * old_shards
    for r in blocks.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect():
        supply[r.old_shard] = r.bytes
    flow = fewest_moves(supply, even_capacity(sum(supply), new_shards), cost)
    ends = []
    for i, sent in enumerate(flow):  # what stays comes first, then what the others get
        at, out = 0, []
        for j in sorted((j for j in sent if sent[j]), key=lambda j: (j != i, j)):
            at += sent[j]
            out.append((at, j))
        ends.append((i, out or [(0, i % new_shards)]))
    transfers = F.broadcast(spark.createDataFrame(ends, "old_shard int, ends array<struct<upto: long, to: int>>"))  # as many as old shards

    order = Window.partitionBy("old_shard").orderBy(F.desc("size_class"), "bucket")
    starts = blocks.withColumn("start", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")).drop("bytes")
    inner = Window.partitionBy(*BLOCK).orderBy(*in_block("size", "doc_id", "text_crc32"))
    placed = rows.withColumn("upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("row", F.row_number().over(inner))
    placed = placed.join(starts, BLOCK).join(transfers, "old_shard")
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    found = F.filter("ends", lambda e: middle < e["upto"])
    placed = placed.withColumn("shard", F.coalesce(F.try_element_at(found, F.lit(1))["to"], F.element_at("ends", -1)["to"]))
    placed = written(placed.select("doc_id", "size", "text_crc32", *BLOCK, "row", "shard"), "reshard-placed")
    erase(rows)

    # a block's rows of one shard are neighbours in the block's order, so the slot follows from their first row's place
    parts = placed.groupBy("shard", *BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    order = Window.partitionBy("shard").orderBy("old_shard", F.desc("size_class"), "bucket")
    parts = parts.select("shard", *BLOCK, "first", "n", (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - F.col("first")).alias("shift"))
    return Placement(placed, written(parts, "reshard-parts"), buckets)


def slots(placement: Placement) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of each row."""
    joined = placement.rows.join(placement.parts.drop("first", "n"), ["shard", *BLOCK])
    return joined.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("row") + F.col("shift")).cast("long").alias("slot"))


def reshard(docs: DataFrame, new_shards: int, old_shards: int, id_col: str = "doc_id", text_col: str = "text", old_shard=None, cost=None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, old_shard, shard, slot (gapless from 0 in a shard).

    ``old_shard``: a Column with the shard (0 to old_shards - 1) that has the row now; default: a hash of id and text.
    The new shards' sizes (UTF-8 bytes and 16 a row; null text has none) are equal but for a part of a row; bytes are
    moved between shards only as far as that needs. Null ids, repeated rows, and empty tables are placed like others;
    other columns are not looked at.
    """
    return slots(place(docs, new_shards, old_shards, id_col, text_col, old_shard, cost))


def affected_shards(plan: DataFrame) -> DataFrame:
    """The new shards that get a row from another shard or whose old shard sends rows: those whose files change."""
    moved = plan.filter("old_shard != shard")
    return moved.select("shard").union(moved.select("old_shard")).distinct()


def write_shards(docs: DataFrame, placement: Placement, path: str, old_shards: int, id_col: str = "doc_id", text_col: str = "text", old_shard=None, only_affected: bool = True) -> None:
    """Writes shard=<n>/ folders under ``path``, rows in slot order in each file: all shards, or those that the placement changes.

    Columns of ``docs`` named shard or slot give way. A shard has a file or more for each block that it gets rows from. Rows with equal
    ids and checksums take their block's numbers in any order; an empty table writes no shard.
    """
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    names = free_names(docs, "doc_id", "size", "text_crc32", "old_shard", "size_class", "bucket", "row")
    id_, size, crc, *block, row = names
    own = [c.alias(n) for c, n in zip(_sized(docs, id_col, text_col, _old_of(old_shard, id_col, text_col, old_shards), placement.buckets), names)]
    rows = docs.select(*keep, *own).repartition(block[0], block[2])
    inner = Window.partitionBy(*block).orderBy(*in_block(size, id_, crc))
    parts = placement.parts
    if only_affected:
        parts = parts.join(F.broadcast(affected_shards(parts)), "shard", "left_semi")  # as few rows as shards
    to, old, size_class, bucket, first, n, shift = taken = free_names(rows, "to", "from", "class", "at", "first", "n", "shift")
    parts = parts.select(*[F.col(c).alias(name) for c, name in zip(("shard", *BLOCK, "first", "n", "shift"), taken)])
    here = (F.col(block[0]) == F.col(old)) & (F.col(block[2]) == F.col(bucket)) & (F.col(block[1]) == F.col(size_class))
    here &= (F.col(row) >= F.col(first)) & (F.col(row) < F.col(first) + F.col(n))
    placed = rows.withColumn(row, F.row_number().over(inner)).join(parts, here)
    placed = placed.select(*keep, F.col(to).alias("shard"), (F.col(row) + F.col(shift)).cast("long").alias("slot"))
    placed.sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` of ``docs`` has written: its columns, slot and shard."""
    keep = [f for f in docs.schema.fields if f.name.lower() not in ("shard", "slot")]
    return docs.sparkSession.read.schema(StructType([*keep, StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)


def rewrite(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", only_affected: bool = True) -> None:
    """Writes shard=<n>/ folders under ``path``, rows in slot order: all shards, or those that the plan changes.

    A row finds its place by id, null or not, and its text's checksum; rows that have both in common take their places in any
    order, one each. Rows are dealt by ranges of (shard, slot), so a shard may have several files.
    """
    id_, crc, nth, own, place_ = free_names(docs, "id", "crc", "nth", "own", "place")
    target = plan.select(F.col("doc_id").alias(id_), F.col("text_crc32").alias(crc), "shard", "slot")
    same = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(1)))
    target = target.withColumn(nth, same(id_, crc))
    if only_affected:
        target = target.join(F.broadcast(affected_shards(plan)), "shard", "left_semi")  # as few rows as shards
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(*keep, F.crc32(body).alias(own))
    rows = rows.withColumn(place_, same(id_col, own))
    rows = rows.join(target, rows[id_col].eqNullSafe(target[id_]) & (F.col(own) == F.col(crc)) & (F.col(place_) == F.col(nth))).drop(id_, crc, own, place_, nth)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
