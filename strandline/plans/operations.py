"""Stores, streams and ledgers: the queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import usage
from strandline.plans import catalogue, chunking
from strandline.sinks.keyed import KeyedTable
from strandline.stored import shared_folder
from strandline.streaming import jobs


def vector_store_units(spark, d):
    """The sections of hosts put into a keyed store, then changed ones, deleted ones and new ones, then the same once more."""
    units = catalogue._section_units(spark, d)
    rows = chunking.vector_rows(units).select("key", "content", "payload")
    table = KeyedTable(spark, shared_folder(spark, "vectors"), ["key"])
    table.merge(rows, batch=("units", 0))
    third, fifth = F.col("unit_id") % 3 == 0, F.col("unit_id") % 5 == 1
    changed = units.filter(third).withColumn("content", F.concat("content", F.lit(" again")))
    new = units.filter("unit_id % 7 = 2").withColumn("unit_id", F.col("unit_id") + 1000)
    second = chunking.vector_rows(changed).withColumn("gone", F.lit(False)).unionByName(chunking.vector_rows(units.filter(fifth & ~third)).withColumn("gone", F.lit(True)))
    added = chunking.vector_rows(new, F.xxhash64("doc_id", "unit_id", F.lit("new")))  # a host of more sections has units of these numbers already
    second = second.unionByName(added.withColumn("gone", F.lit(False)))
    for _ in range(2):
        table.merge(second, deleted=F.col("gone"), batch=("units", 1))
    payload = lambda name: F.get_json_object("payload", f"$.{name}")
    return table.read().select(payload("doc_id").alias("doc_id"), payload("unit_id").cast("long").alias("unit_id"), F.md5("content").alias("digest"))


def graph_store_edges(spark, d):
    """The relations of conversations put into a keyed store: reading order first, then what overrides it; every seventh one leaves."""
    speech = catalogue._speech(spark, d, True)
    from strandline.operators import graph

    table = KeyedTable(spark, shared_folder(spark, "edges"), ["doc_id", "src", "dst"])
    table.merge(graph.next_edges(speech).select("doc_id", "src", "dst", "type", "confidence"))
    found = graph.resolve(graph.next_edges(speech).union(graph.question_edges(speech)))
    table.merge(found.select("doc_id", "src", "dst", "type", "confidence"))
    kept = table.read()
    table.merge(kept.filter("doc_id % 7 = 3"), deleted=F.lit(True))
    return table.read().select("doc_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "type", "confidence")


def ledger_cumulative(spark, d):
    """Events as calls in ten batches that add up in a keyed store; two batches come twice."""
    model = F.element_at(F.array(*map(F.lit, ("gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.0-flash", "ollama/small", "unknown-1"))), (F.col("user_id") % 5 + 1).cast("int"))
    calls = spark.read.parquet(f"{d}/events.parquet").select(model.alias("model"), (F.col("event_id") % 997).alias("in_tokens"), (F.col("event_id") % 101).alias("out_tokens"), (F.col("event_id") % 53).alias("cached_tokens"), (F.col("event_id") % 10).alias("batch"))
    table = KeyedTable(spark, shared_folder(spark, "ledger"), ["model"], buckets=4)
    for k in (0, 1, 2, 2, 3, 4, 5, 6, 6, 7, 8, 9):
        usage.add_to_ledger(table, calls.filter(F.col("batch") == k), ("calls", k))
    return usage.cumulative(table)


def job_status(spark, d):
    """Events as those of users' jobs, streamed in two runs from one checkpoint; the second has the last day of the first once more."""
    rows = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_id") % 401 == 0, "done").when(F.col("event_id") % 307 == 0, "error").otherwise("progress")
    rows = rows.select("event_id", F.col("user_id").alias("job_id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), (F.col("value") / 5).alias("progress"))
    middle, day = "timestamp '2024-01-16 00:00:00'", "timestamp '2024-01-15 00:00:00'"
    folder = shared_folder(spark, "jobs")
    table = KeyedTable(spark, f"{folder}/status", ["job_id"], buckets=16)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, jobs.PROVIDER)
    try:
        for part in (f"ts < {middle}", f"ts >= {day}"):
            rows.filter(part).write.mode("append").parquet(f"{folder}/events")
            events = spark.readStream.schema(jobs.EVENT).parquet(f"{folder}/events")
            jobs.keep_status(jobs.job_status(events), table, f"{folder}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return table.read().select("job_id", "status", F.col("progress").cast("long").alias("progress"), "events", "last_event", "silent")


def queries() -> dict:
    return {f.__name__: f for f in (vector_store_units, graph_store_edges, ledger_cumulative, job_status)}


def oracle_sql() -> dict[str, str]:
    from strandline.plans.oracle import HOSTS, QA
    from strandline.plans.oracle import oracle_sql as others

    return {
        "ledger_cumulative": others()["usage_ledger"],
        "vector_store_units": f"""WITH {HOSTS} SELECT doc_id, unit_id, md5(CASE WHEN unit_id % 3 = 0 THEN content || ' again' ELSE content END) AS digest FROM units WHERE unit_id % 3 = 0 OR unit_id % 5 <> 1
            UNION ALL SELECT doc_id, unit_id + 1000, md5(content) FROM units WHERE unit_id % 7 = 2""",
        "graph_store_edges": f"WITH {QA} SELECT doc_id, src, dst, type, confidence FROM edges WHERE doc_id % 7 <> 3",
        "job_status": """
            WITH e AS (SELECT user_id AS job_id, event_id, date_trunc('second', ts) AS ts, least(99, floor(value / 5))::BIGINT AS p, CASE WHEN event_id % 401 = 0 THEN 'done' WHEN event_id % 307 = 0 THEN 'error' END AS ended FROM events),
            m AS (SELECT max(ts) FILTER (ts < TIMESTAMP '2024-01-16') AS first_end, max(ts) AS last_end FROM e),
            j AS (SELECT job_id, max(p) AS p, count(*) AS events, arg_max(event_id, (epoch_ms(ts), event_id)) AS last_event, max(ts) AS last_ts, arg_max(ended, (epoch_ms(ts), event_id)) FILTER (ended IS NOT NULL) AS ended FROM e GROUP BY job_id)
            SELECT job_id, coalesce(ended, 'running') AS status, CASE WHEN ended = 'done' THEN 100 ELSE p END AS progress, events, last_event, ended IS NULL AND last_ts + INTERVAL 7 DAY < last_end - INTERVAL 2 DAY AS silent FROM j, m""",
    }
