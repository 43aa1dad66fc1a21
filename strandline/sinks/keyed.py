"""A table of rows by key, merged by copy on write.

Rows are dealt to a fixed number of buckets by their key's hash. A merge writes the changed buckets anew into a folder of its
own and then puts up a manifest that names each bucket's folder; readers take the manifest with the highest number. A merge
that is lost half-way leaves a folder that no manifest names (``sweep`` deletes those), and of two merges at once one
finds its number taken and fails. A manifest also has the numbers of the batches it includes, so a batch that is sent
again, as a stream does after a failure, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class KeyedTable:
    """``path``: a folder that all executors see; ``keys``: the columns that name a row."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        found = self.manifest()
        self.buckets = found["bucket_count"] if found else buckets

    def _fs(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        place, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        place, fs = self._fs(f"{self.path}/manifests/{numbers[-1]:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put_up(self, number: int, content: dict) -> None:
        """The manifest under its number, whole or not at all; an error if that is taken."""
        place, fs = self._fs(f"{self.path}/manifests/{number:012d}.json")
        draft, _ = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        if fs.exists(place) or not fs.rename(draft, place):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: another merge has put up manifest {number}")

    def bucket(self, columns: list[str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*(columns or self.keys)), F.lit(self.buckets)).cast("int")

    def read(self, schema: StructType | None = None) -> DataFrame | None:
        """All rows, or None before the first merge."""
        found = self.manifest()
        if not found:
            return None
        kept = StructType.fromJson(found["schema"])
        return self._of(found, sorted(found["buckets"]), kept).select(*(schema or kept).fieldNames())

    def _of(self, manifest: dict | None, buckets: list[str], schema: StructType) -> DataFrame:
        paths = [f"{self.path}/data/{manifest['buckets'][b]}/bucket={b}" for b in buckets] if manifest else []
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, changes: DataFrame, deleted: Column | None = None, combine: dict[str, Callable[[Column, Column], Column]] | None = None, order: Column | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Inserts, updates and deletes by key; the numbers of rows inserted, updated, deleted, kept (in changed buckets).

        ``deleted``: which of ``changes`` delete their key. ``combine``: for some columns, what old and new value make (default:
        the new one). ``order``: of several changes of a key the one with the greatest counts; without it keys must be single.
        ``batch``: (source, number): nothing is done if a batch of that source with that number or a later one is in already.
        Null keys are keys like others. The table has the columns of its first merge.
        """
        now = self.manifest()
        none = dict.fromkeys(("inserted", "updated", "deleted", "kept"), 0)
        if batch and now and now["batches"].get(batch[0], -1) >= batch[1]:
            return none
        schema = StructType.fromJson(now["schema"]) if now else StructType([StructField(f.name, f.dataType) for f in changes.schema.fields])
        values = [c for c in schema.fieldNames() if c not in self.keys]
        gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
        rows = changes.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)], F.struct(*[F.col(c) for c in values], F.lit(True).alias("is")).alias("new"), gone.alias("gone"), *([order.alias("order")] if order is not None else []))
        own = [f"k{i}" for i in range(len(self.keys))]
        if order is not None:
            best = F.max_by(F.struct("new", "gone"), "order").alias("b")
            rows = rows.groupBy(*own).agg(best).select(*own, "b.new", "b.gone")
        rows = rows.withColumn("bucket", self.bucket(own))
        touched = sorted(str(r.bucket) for r in rows.select("bucket").distinct().collect())  # at most as many as buckets
        held = [b for b in touched if now and b in now["buckets"]]
        old = self._of(now, held, schema).select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(self.keys)], F.struct(*[F.col(c) for c in values], F.lit(True).alias("is")).alias("old"))
        same = F.lit(True)
        for i in range(len(own)):
            same = same & F.col(f"k{i}").eqNullSafe(F.col(f"o{i}"))
        both = rows.join(old, same, "full")
        key = [F.when(F.col("new.is"), F.col(f"k{i}")).otherwise(F.col(f"o{i}")).alias(k) for i, k in enumerate(self.keys)]
        combine = combine or {}

        def value(c: str) -> Column:
            new, before = F.col(f"new.{c}"), F.col(f"old.{c}")
            made = F.when(F.col("old.is"), combine[c](before, new)).otherwise(new) if c in combine else new
            return F.when(F.col("new.is"), made).otherwise(before).alias(c)

        what = F.when(F.col("gone"), F.when(F.col("old.is"), "deleted").otherwise("none")).when(F.col("new.is"), F.when(F.col("old.is"), "updated").otherwise("inserted")).otherwise("kept")
        made = both.select(*key, *[value(c) for c in values], what.alias("what"))
        attempt = uuid.uuid4().hex
        folder = f"{self.path}/data/{attempt}"
        out = made.withColumn("bucket", self.bucket()).repartition("bucket")
        out.write.partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(StructType([*schema.fields, StructField("what", made.schema["what"].dataType), StructField("bucket", IntegerType())])).parquet(folder)
        counts = {(r.bucket, r.what): r.n for r in written.groupBy("bucket", "what").agg(F.count(F.lit(1)).alias("n")).collect()}
        there = {str(b) for b, _ in counts}
        if any(w in ("deleted", "none") for _, w in counts):  # rows that say what is deleted aren't part of the table
            attempt = uuid.uuid4().hex
            rest = written.filter("what not in ('deleted', 'none')")
            rest.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{attempt}")
            there = {str(b) for (b, w) in counts if w not in ("deleted", "none")}
        buckets = {b: v for b, v in (now["buckets"] if now else {}).items() if b not in touched} | dict.fromkeys(there, attempt)
        batches = (now["batches"] if now else {}) | ({batch[0]: batch[1]} if batch else {})
        number = (self._numbers() or [-1])[-1] + 1 if not now else now["number"] + 1
        self._put_up(number, {"number": number, "bucket_count": self.buckets, "schema": schema.jsonValue(), "buckets": buckets, "batches": batches})
        return none | {w: sum(n for (_, x), n in counts.items() if x == w) for w in none}

    def sweep(self, keep: int = 1) -> int:
        """Deletes the data folders that none of the last ``keep`` manifests names, and older manifests; how many folders went. Not
        while merges run."""
        numbers = self._numbers()
        last = numbers[-keep:]
        named = set()
        for n in last:
            place, fs = self._fs(f"{self.path}/manifests/{n:012d}.json")
            stream = fs.open(place)
            named |= set(json.loads(bytes(stream.readAllBytes()))["buckets"].values())
            stream.close()
        for n in numbers[: -len(last) or None] if last else []:
            place, fs = self._fs(f"{self.path}/manifests/{n:012d}.json")
            fs.delete(place, False)
        place, fs = self._fs(f"{self.path}/data")
        stale = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName() not in named] if fs.exists(place) else []
        for p in stale:
            fs.delete(p, True)
        return len(stale)
