"""Intermediate tables that cut a long plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where false, joins by a document and more keep rows where they are if these are dealt out by document already.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the one that ``spark.checkpoint.dir`` names; in one of our own only where that is unset on a single machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="strandline-")
        context.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, by_document: bool = False) -> DataFrame:
    """``df`` by way of a compressed table in a fresh ``shared_folder``. It is made once, where an eager checkpoint computes its rows
    twice and writes them as they are in memory, and the shuffle files that made it go as soon as it is there. ``by_document``: rows
    that windows have dealt out by a document stay there for joins by it and more."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "stored")
    own = {CLEANUP: "true"} | ({ALL_KEYS: "false"} if by_document else {})
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
