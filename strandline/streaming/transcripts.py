"""Live transcripts: segments stream in, turns of a speaker come out when they are over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "doc_id STRING, speaker STRING, ts TIMESTAMP, text STRING"


def read_segments(spark: SparkSession, path: str, schema: str = SEGMENT, files_a_trigger: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def live_turns(segments: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """A speaker's turn ends after ``gap`` without a segment; segments later than ``late`` are dropped."""
    rows = segments.withWatermark("ts", late).groupBy("doc_id", "speaker", F.session_window("ts", gap).alias("w"))
    turns = rows.agg(F.count(F.lit(1)).alias("segments"), F.sort_array(F.collect_list(F.struct("ts", "text"))).alias("s"))
    content = F.array_join(F.transform("s", lambda x: x["text"]), " ")
    return turns.select("doc_id", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "segments", content.alias("content"))


def write_turns(turns: DataFrame, path: str, checkpoint: str):
    return turns.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
