import math
import random
from hashlib import sha256

import numpy as np
import pytest

from strandline.llm import ball_tree, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters=16, rounds=3, dims=64):
    """The same by the definition: all distances, Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: sha256(f"1:{r[0]}".encode()).hexdigest())
    cents = [x for _, x in order[:clusters]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: min(range(len(cents)), key=lambda c: (dist(x, cents[c]), c))
    for _ in range(rounds):
        at = [near(x) for _, x in kept]
        new = list(cents)
        for c in set(at):
            own = [x for a, (_, x) in zip(at, kept) if a == c]
            new[c] = [sum(v) // len(own) for v in zip(*own)]
        cents = new
    found = [(i, near(x), x) for i, x in kept]
    sums = {}
    for _, c, x in found:
        sums[c] = sums.get(c, 0) + dist(x, cents[c])
    digest = lambda c: sha256(",".join(map(str, cents[c])).encode()).hexdigest()
    return sorted((i, c, dist(x, cents[c]), sums[c], sum(sums.values()), digest(c)) for i, c, x in found)


def test_the_query_is_the_definition(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_ball_tree(spark, small).collect())) == plain(rows)


def test_copies_ties_and_odd_vectors(spark):
    draw = random.Random(3)
    centre = [[draw.choice([-2.0, 0.0, 1.5]) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + draw.choice([0, 0, 0.02]) for x in centre[i % 5]]) for i in range(300)] + [(1000 + i, centre[0]) for i in range(400)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, [None] + [0.0] * 63), (2006, [0.0] * 65)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, ball_tree.cluster(df).collect())) == plain(rows)


def test_few_none_repeated_and_null_ids(spark):
    empty = ball_tree.cluster(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    df = spark.createDataFrame([(None, [0.5] * 64, 0), (1, [0.25] * 64, 0), (1, [0.25] * 64, 1)], SCHEMA).withColumnsRenamed({"label": "cluster"})
    out = ball_tree.cluster(df.withColumnRenamed("cluster", "distance"))
    assert sorted(((r.vec_id or -1), r.distance) for r in out.collect()) == [(-1, 0), (1, 0), (1, 0)]
    names = spark.createDataFrame([("a", [1.0] * 64), ("b", [2.0] * 64)], "vec_id string, embedding array<double>")
    assert {r.vec_id for r in ball_tree.cluster(names).collect()} == {"a", "b"}


@pytest.mark.parametrize("spread", [1, 40, 1 << 24])
def test_sifted_balls_are_the_nearest(spread):
    draw = np.random.default_rng(spread)
    heart = draw.integers(-spread * 9, spread * 9, (6, 64))
    x = heart[draw.integers(0, 6, 3000)] + draw.integers(-spread, spread + 1, (3000, 64))
    order, nodes, radii, sums = ball_tree.grow(x)
    centroids = np.concatenate([heart, heart[:2], x[:3]])
    whole, leaves = ball_tree.sift(nodes, radii, sums, centroids)
    plain_d = ((x[order][:, None, :] - centroids[None]) ** 2).sum(2)
    at = plain_d.argmin(1)
    covered = np.zeros(len(x), int)
    for k, c in whole:
        assert (at[nodes[k, 0] : nodes[k, 1]] == c).all()
        covered[nodes[k, 0] : nodes[k, 1]] += 1
    for k in leaves:
        covered[nodes[k, 0] : nodes[k, 1]] += 1
        assert (ball_tree.nearest(x[order][nodes[k, 0] : nodes[k, 1]], centroids) == at[nodes[k, 0] : nodes[k, 1]]).all()
    assert (covered == 1).all() and whole
    assert (sums[0] == x.sum(0)).all()
