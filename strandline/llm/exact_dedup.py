"""Exact deduplication by content sort, with built-in DataFrame operations only.

Rows are dealt by range over (first characters, 64-bit hash, salt) with splitters that Spark samples, every
partition is sorted (externally where it doesn't fit) by those and the whole text, and neighbours with equal
whole texts form a run. The range keys are short, so that the sampled splitters stay small whatever the texts.

Copies of one text may be a third of all rows. Texts with more rows than a quarter of a partition's share are
found first by a pre-aggregated count of hashes (by pigeonhole fewer than four for each partition); their runs
are salted by id, and the heads of the salted runs, again compared as whole texts, give the whole group's figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.shared import free_names, shuffle_partitions

PREFIX_CHARS = 16
#: A text is salted if it has more than a share of 1 / (HOT_SHARE * partitions) of all rows.
HOT_SHARE = 4


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts whose normalised forms (``normalise``: Column -> Column, default: as they are) are identical.
    Null text counts as empty, empty texts are equal to each other. Of a group the row with the largest (or
    ``keep='smallest'``) id is kept; of rows that repeat that id too, one. A null id is kept only in a group without
    other ids. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (normalise(text) if normalise else text).alias("body")).withColumn("h", F.xxhash64("body"))

    total, parts = docs.count(), shuffle_partitions(spark)
    share = max(1, total // (HOT_SHARE * parts))
    counted = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = counted.filter(F.col("n") > share).select("h", F.ceil(F.col("n") / share).cast("int").alias("salts")).collect()  # fewer than HOT_SHARE * parts + 1
    if not hot:
        return _runs(rows, keep).select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), _first(F.col("run_keep")).alias("kept"), "text_sha256")

    spread = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], "h long, salts int"))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"), F.lit(-1))
    every = _runs(rows.join(spread, "h", "left").withColumn("salt", salt), keep)
    best = F.max if keep == "largest" else F.min
    heads = _runs(rows.join(spread, "h").withColumn("salt", salt), keep).filter("at = 1")
    whole = heads.groupBy("h", "body").agg(best("run_keep").alias("whole_keep"), F.sum("run_size").alias("whole_size"))
    whole = whole.select("h", F.sha2("body", 256).alias("text_sha256"), "whole_keep", "whole_size")  # as few rows as hot
    joined = every.select("doc_id", "h", "at", "run_keep", "run_size", "text_sha256").join(F.broadcast(whole), ["h", "text_sha256"], "left")
    kept_id = F.when(F.col("whole_size").isNull(), F.col("run_keep")).otherwise(F.col("whole_keep"))
    return joined.select("doc_id", kept_id.alias("keep_id"), F.coalesce("whole_size", "run_size").alias("group_size"), _first(kept_id).alias("kept"), "text_sha256")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text: that with the id that is kept, of rows that repeat it one. A null id
    stays only where its text has no other. All columns are carried along; an empty table gives an empty result."""
    normalise = options.get("normalise")
    id_, sha, stays, copies, first = free_names(docs, "id", "sha", "stays", "copies", "first")
    decided = exact_duplicates(docs, id_col, text_col, **options)
    pairs = decided.groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.bool_or("kept").alias(stays), F.count(F.lit(1)).alias(copies))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(pairs, F.col(id_col).eqNullSafe(F.col(id_)) & (F.sha2(normalise(text) if normalise else text, 256) == F.col(sha))).filter(F.col(stays))
    nth = F.row_number().over(Window.partitionBy(id_, sha).orderBy(F.lit(1)))
    single = joined.filter(F.col(copies) == 1).select(*docs.columns)
    return single.union(joined.filter(F.col(copies) > 1).withColumn(first, nth).filter(F.col(first) == 1).select(*docs.columns))


def _first(keep_id: Column) -> Column:
    return (F.col("at") == 1) & F.col("doc_id").eqNullSafe(keep_id)


def _runs(rows: DataFrame, keep: str) -> DataFrame:
    """Content sort: neighbours of equal (h, salt, whole text), with each row's place ``at`` in its run."""
    keys = ["prefix", "h", *(["salt"] if "salt" in rows.columns else [])]  # Window finds equal texts where these have dealt them
    dealt = rows.withColumn("prefix", F.substring("body", 1, PREFIX_CHARS)).select("doc_id", "body", *keys).repartitionByRange(*keys)
    run = Window.partitionBy(*keys, "body")
    ranked = run.orderBy(F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last())
    return dealt.select("doc_id", "body", "h", F.row_number().over(ranked).alias("at"), F.first("doc_id").over(ranked).alias("run_keep"), F.count(F.lit(1)).over(run).alias("run_size"), F.sha2("body", 256).alias("text_sha256"))
