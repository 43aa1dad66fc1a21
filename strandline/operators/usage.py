"""Costs of model calls: prices by model, a ledger as an aggregate of appended calls, and batches of flagged units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# US dollars a million tokens (model's prefix, input, output, cached input) and for models not listed.
PRICES = [
    ("gemini-2.5-flash", 0.30, 2.50, 0.075),
    ("gemini-2.5-flash-lite", 0.10, 0.40, 0.025),
    ("gemini-3.7-flash", 0.375, 1.875, 0.09),
    ("gemini-3.6-flash", 0.75, 3.75, 0.1875),
    ("gemini-2.0-flash", 0.10, 0.40, 0.025),
]
DEFAULT = (0.30, 2.50, 0.075)
LOCAL = r"^(local|ollama|mlx)/"
BATCH, CHUNK_CHARS, DOCUMENT_CHARS = 6, 2400, 24_000


def priced(calls: DataFrame) -> DataFrame:
    """``calls`` (model, in_tokens, out_tokens, cached_tokens) with cost and ``estimated``. The first listed prefix counts;
    local models cost nothing; others the default, as an estimate."""
    which = F.when(F.col("model").rlike(LOCAL), -1)
    for k, (prefix, *_) in enumerate(PRICES):
        which = which.when(F.col("model").startswith(prefix), k)
    rows = calls.withColumn("__which", which.otherwise(len(PRICES)))
    table = [p[1:] for p in PRICES] + [DEFAULT]
    rate = lambda k: F.coalesce(F.get(F.array(*[F.lit(p[k]) for p in table]), F.col("__which")), F.lit(0.0))
    fresh = F.greatest(F.lit(0), F.col("in_tokens") - F.col("cached_tokens"))
    cost = (fresh * rate(0) + F.col("cached_tokens") * rate(2) + F.col("out_tokens") * rate(1)) / 1e6
    return rows.withColumns({"cost": cost, "estimated": F.col("__which") == len(PRICES)}).drop("__which")


def ledger(calls: DataFrame) -> DataFrame:
    """Sums by model, dearest first."""
    sums = priced(calls).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"), F.sum("cached_tokens").alias("cached_tokens"),
        F.round(F.sum("cost"), 6).alias("cost"), F.bool_or("estimated").alias("estimated"),
        F.round(100 * F.sum("cached_tokens") / F.nullif(F.sum("in_tokens"), F.lit(0)), 1).alias("cache_hit_pct"),
    )
    return sums.orderBy(F.desc("cost"), "model")


SUMS = ["calls", "in_tokens", "out_tokens", "cached_tokens", "cost"]


def add_to_ledger(table, calls: DataFrame, batch: tuple[str, int]) -> None:
    """Adds a batch of calls (see ``priced``) to the sums by model in ``table`` (a ``KeyedTable`` by model), once however often it comes."""
    sums = priced(calls).groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), *[F.coalesce(F.sum(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("in_tokens", "out_tokens", "cached_tokens")],
        F.sum(F.round(F.col("cost") * 10**12).cast("decimal(38,0)")).alias("cost"), F.bool_or("estimated").alias("estimated"),
    )
    table.merge(sums, combine=dict.fromkeys(SUMS, lambda old, new: old + new) | {"cost": lambda old, new: (old + new).cast("decimal(38,0)"), "estimated": lambda old, new: old | new}, batch=batch)


def cumulative(table) -> DataFrame:
    """The sums by model that ``table`` has, dearest first, as ``ledger`` gives them; costs are added up in whole millionths of a
    millionth, so that their order says nothing."""
    rows = table.read()
    pct = F.round(100 * F.col("cached_tokens") / F.nullif(F.col("in_tokens"), F.lit(0)), 1)
    cost = F.round(F.col("cost").cast("double") / 10**12, 6)
    return rows.select("model", "calls", "in_tokens", "out_tokens", "cached_tokens", cost.alias("cost"), "estimated", pct.alias("cache_hit_pct")).orderBy(F.desc("cost"), "model")


def fence(text):
    """Text that can't close or open the marks of a prompt."""
    out = text
    for mark in ("</document>", "</chunk>", "<chunk"):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "​" + mark[1:]))
    return out


def batches(flagged: DataFrame, size: int = BATCH) -> DataFrame:
    """Flagged units (doc_id, unit_id, content) in batches of a document, each with its prompt's chunks."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_id")) - 1
    rows = flagged.withColumn("batch", F.floor(number / size))
    chunk = F.concat(F.lit("<chunk id=\""), F.col("unit_id").cast("string"), F.lit("\">\n"), fence(F.substring("content", 1, CHUNK_CHARS)), F.lit("\n</chunk>"))
    parts = F.sort_array(F.collect_list(F.struct("unit_id", chunk.alias("chunk"))))
    return rows.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("units"), F.array_join(F.transform(parts, lambda p: p["chunk"]), "\n").alias("prompt"))


def prompts(flagged: DataFrame, documents: DataFrame, size: int = BATCH) -> DataFrame:
    """doc_id, batch, units, prompt: the document (doc_id, text; its first DOCUMENT_CHARS characters) once for each batch of
    its flagged units (doc_id, unit_id, content, heading_path), which stand after it with their sections."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_id")) - 1
    where = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " › ")).otherwise("(no section)")
    chunk = F.concat(F.lit('<chunk id="'), F.col("unit_id").cast("string"), F.lit('" section="'), F.replace(fence(where), F.lit('"'), F.lit("'")), F.lit('">\n'), fence(F.substring("content", 1, CHUNK_CHARS)), F.lit("\n</chunk>"))
    rows = flagged.withColumns({"batch": F.floor(number / size), "chunk": chunk})
    rows = rows.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("units"), F.sort_array(F.collect_list(F.struct("unit_id", "chunk"))).alias("parts"))
    head = documents.select("doc_id", fence(F.substring(F.coalesce("text", F.lit("")), 1, DOCUMENT_CHARS)).alias("document"))
    ask = F.format_string("<document>\n%s\n</document>\n\nSay where each of these %d chunks stands in the document.\n", F.coalesce("document", F.lit("")), F.col("units"))
    return rows.join(head, "doc_id", "left").select("doc_id", "batch", "units", F.concat(ask, F.lit("\n"), F.array_join("parts.chunk", "\n")).alias("prompt"))


REPLY = "results array<struct<id: string, summary: string, entities: array<string>>>"
ENTITIES = 8


def apply_replies(units: DataFrame, replies: DataFrame) -> DataFrame:
    """``units`` (doc_id, unit_id, ...) with summary, tier (0 without a summary, 1 by a local model, 2 by a paid one), entities,
    llm_calls and cost_usd, the unit's share of its batch's cost.

    ``replies``: doc_id, batch, units (of the batch), reply (JSON), model, cost. Of several summaries of a unit the first one by
    batch and place counts; replies that are no JSON, empty summaries and ids of no unit count for nothing.
    """
    local = F.col("model").rlike(LOCAL)
    rows = replies.select("doc_id", "batch", local.alias("local"), (F.col("cost") / F.greatest("units", F.lit(1))).alias("share"), F.posexplode(F.from_json("reply", REPLY)["results"]).alias("place", "r"))
    rows = rows.withColumn("summary", F.trim("r.summary")).filter("summary != ''")
    first = F.min_by(F.struct("summary", "local", "share", F.coalesce("r.entities", F.array().cast("array<string>")).alias("entities")), F.struct("batch", "place"))
    found = rows.groupBy("doc_id", F.col("r.id").alias("__id")).agg(first.alias("s"))
    joined = units.join(found.withColumnRenamed("doc_id", "__doc"), F.expr("doc_id = __doc and cast(unit_id as string) = __id"), "left")
    has = F.col("s").isNotNull()
    made = {"summary": F.col("s.summary"), "tier": F.when(has, F.when(F.col("s.local"), 1).otherwise(2)).otherwise(0), "entities": F.coalesce(F.slice(F.array_compact("s.entities"), 1, ENTITIES), F.array().cast("array<string>")), "llm_calls": has.cast("int"), "cost_usd": F.coalesce("s.share", F.lit(0.0))}
    return joined.withColumns(made).drop("__doc", "__id", "s")


# What of the reports of files is added up; the rest is the last file's.
ADDED = ["flagged", "enriched", "api_calls", "calls_saved_by_batching", "failed_calls"]


def merge_reports(reports: DataFrame, number: str = "number") -> DataFrame:
    """One report of those of several files: sums of ADDED, and of other columns the value of the file with the greatest ``number``."""
    others = [c for c in reports.columns if c not in (*ADDED, number)]
    return reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ADDED], *[F.max_by(c, number).alias(c) for c in others if c != "doc_id"])


def merge_entities(units: DataFrame, found: DataFrame) -> DataFrame:
    """``units`` with ``entities`` (as they were, then new ones of ``found``: doc_id, unit_id, entities; each once)."""
    new = found.groupBy("doc_id", "unit_id").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("__new"))
    rows = units.join(new, ["doc_id", "unit_id"], "left")
    return rows.withColumn("entities", F.array_union("entities", F.coalesce("__new", F.array().cast("array<string>")))).drop("__new")


def enrich(flagged: DataFrame, complete=None, size: int = BATCH) -> DataFrame:
    """doc_id, batch, reply for each batch; ``complete``: list of prompts to list of replies, by default none are made."""
    kinds = dict(flagged.dtypes)

    def asked(frames):
        for pdf in frames:
            yield pdf[["doc_id", "batch"]].assign(reply=complete(pdf["prompt"].tolist()) if complete else None)

    return batches(flagged, size).mapInPandas(asked, f"doc_id {kinds['doc_id']}, batch long, reply string")
