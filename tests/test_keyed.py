import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import usage
from strandline.sinks.keyed import KeyedTable
from strandline.streaming import jobs


def rows_of(table):
    return {tuple(r) for r in table.read().collect()}


def test_random_merges_are_those_of_a_dictionary(spark, tmp_path):
    draw, held = random.Random(5), {}
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["a", "b"], buckets=5)
    assert table.read() is None
    for round_ in range(4):
        keys = {(draw.choice([None, 1, 2, 3]), draw.choice("xyzw")) for _ in range(7)}
        changes = [(a, b, draw.randrange(99), draw.random() < 0.3 and round_ > 0) for a, b in keys]
        want = {"inserted": 0, "updated": 0, "deleted": 0}
        for a, b, v, gone in changes:
            there = (a, b) in held
            if gone:
                want["deleted"] += there
                held.pop((a, b), None)
            else:
                want["updated" if there else "inserted"] += 1
                held[a, b] = v
        got = table.merge(spark.createDataFrame(changes, "a int, b string, v int, gone boolean").select("v", "b", "a", "gone").drop("gone") if not round_ else spark.createDataFrame(changes, "a int, b string, v int, gone boolean"), deleted=F.col("gone") if round_ else None)
        assert {k: got[k] for k in want} == want
        assert {(r.a, r.b, r.v) for r in table.read().collect()} == {(a, b, v) for (a, b), v in held.items()}
    assert table.sweep() >= 3 and {(r.a, r.b) for r in table.read().collect()} == set(held)


def test_a_batch_counts_once_and_changes_of_a_key_in_order(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=3)
    one = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 1, 1)], "k int, n int, at int")
    add = {"n": lambda old, new: old + new}
    assert table.merge(one, order=F.col("at"), batch=("s", 0))["inserted"] == 2
    for _ in range(2):
        table.merge(one.filter("at = 1"), combine=add, batch=("s", 1))
    assert {(r.k, r.n) for r in table.read().collect()} == {(1, 12), (2, 2)}
    assert table.merge(one, batch=("s", 0), order=F.col("at"))["updated"] == 0
    assert table.merge(one.limit(0))["updated"] == 0 and table.read().count() == 2


def test_lost_and_competing_merges(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=2)
    table.merge(spark.createDataFrame([(1, "a")], "k int, v string"))
    (tmp_path / "t/data/lost/bucket=0").mkdir(parents=True)
    spark.createDataFrame([(9, "z")], "k int, v string").write.mode("append").parquet(f"file://{tmp_path}/t/data/lost/bucket=0")
    assert rows_of(table) == {(1, "a")}
    number = json.loads((tmp_path / "t/manifests/000000000000.json").read_text())["number"]
    with pytest.raises(RuntimeError, match="another merge"):
        table._put_up(number, {})
    assert table.sweep() == 1 and rows_of(table) == {(1, "a")}


def test_ledger_adds_up(spark, tmp_path):
    calls = spark.createDataFrame([("gemini-2.5-flash", 1000, 10, 100), ("ollama/x", 5, 5, 0), ("odd", 7, 7, 7)], "model string, in_tokens long, out_tokens long, cached_tokens long")
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["model"], buckets=2)
    for k in (0, 0, 1, 1):
        usage.add_to_ledger(table, calls, ("c", k))
    assert {tuple(r) for r in usage.cumulative(table).collect()} == {tuple(r) for r in usage.ledger(calls.union(calls)).collect()}


def test_job_status_over_restarts(spark, tmp_path):
    day = 86_400
    rows = [(1, 1, 0, "progress", 50.0), (2, 1, 10, "progress", 20.0), (3, 2, 5, "done", 1.0), (4, 3, 6, "error", None), (5, 4, 7, "progress", 250.0)]
    later = [(2, 1, 10, "progress", 90.0), (6, 1, 40, "progress", 30.0), (7, 2, 60, "progress", 70.0)]
    last = [(8, 9, 20 * day, "progress", 1.0)]
    end = [(9, 9, 20 * day + 5, "progress", 2.0)]
    table = KeyedTable(spark, f"file://{tmp_path}/status", ["job_id"], buckets=2)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, jobs.PROVIDER)
    try:
        for part in (rows, later, last, end):
            df = spark.createDataFrame(part, "event_id long, job_id long, s int, kind string, progress double")
            df.select("event_id", "job_id", F.timestamp_seconds(1_700_000_000 + F.col("s")).alias("ts"), "kind", "progress").write.mode("append").parquet(f"file://{tmp_path}/in")
            events = spark.readStream.schema(jobs.EVENT).parquet(f"file://{tmp_path}/in")
            jobs.keep_status(jobs.job_status(events), table, f"file://{tmp_path}/check").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = {r.job_id: (r.status, r.progress, r.events, r.silent) for r in table.read().collect()}
    assert got == {1: ("running", 50, 3, True), 2: ("done", 100, 2, False), 3: ("error", 0, 1, False), 4: ("running", 99, 1, True), 9: ("running", 2, 2, False)}
