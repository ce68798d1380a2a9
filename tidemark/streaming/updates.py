"""Incremental updates by Structured Streaming: arriving raw index pages become rows of a failure-safe table.

Each micro-batch does what a re-run does: rows that failed for good are left out, then comes a keyed upsert.
Upserts are keyed, so a batch replayed after a lost executor changes nothing. The order of captures is their
timestamp, not their arrival, so late ones need no watermark.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schema
from tidemark.operators import captures as C
from tidemark.operators import error_parse

RAW = "line_id bigint, page_no bigint, line_no int, kind string, raw string"


def parsed(lines: DataFrame) -> DataFrame:
    """Good index records of a batch of raw lines as rows with row_ord."""
    good = error_parse.parse_lines(lines).filter(F.col("reason").isNull() & (F.col("kind") == "index"))
    return good.select(F.col("line_id").alias("row_ord"), *[F.get("fields", i).alias(n) for i, n in enumerate(schema.INDEX_COLUMNS)])


class BucketTable:
    """A keyed Parquet table in buckets, on any file system Spark reaches.

    A write replaces only the buckets its keys fall into: each gets a folder of the write's number, and a new list of
    which folder holds which bucket is renamed into place last, so readers see a write as a whole or not at all.
    Folders no list names any more are deleted two writes later. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(self.root))

    def _lists(self) -> list[int]:
        names = [s.getPath().getName() for s in self.files.listStatus(self.path(self.root))]
        return sorted(int(n[5:]) for n in names if n.startswith("list-"))

    def version(self) -> int:
        """Number of the last write, 0 before the first."""
        return max(self._lists(), default=0)

    def placed(self, version: int | None = None) -> dict[int, int]:
        """The write that holds each bucket; the number of buckets is the first write's for good."""
        v = self.version() if version is None else version
        if not v:
            return {}
        data = json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/list-{v}").collect()))  # one line
        self.buckets = data["buckets"]
        return {int(k): n for k, n in data["placed"].items()}

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _read(self, placed: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.root}/data-{n}/bucket={b}" for b, n in placed.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """All rows; None before the first write."""
        return self._read(self.placed())

    def upsert(self, rows: DataFrame) -> None:
        """Fold rows in: new ones of a key replace old ones, the last by row_ord counts."""
        placed, v = self.placed(), self.version() + 1
        kept = self._bucket(rows).persist()
        try:
            touched = [r.bucket for r in kept.select("bucket").distinct().collect()]  # at most as many as buckets
            if not touched:
                return
            old = self._read({b: n for b, n in placed.items() if b in touched})
            base = self._bucket(old) if old is not None else kept.filter("false")
            merged = C.upsert(base.drop("bucket"), kept.drop("bucket"), self.keys)
            self._bucket(merged).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data-{v}")
        finally:
            kept.unpersist()
        placed.update({b: v for b in touched})
        part = f"{self.root}/part-{v}"
        line = json.dumps({"buckets": self.buckets, "placed": placed})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(part)
        self.files.rename(self.path(part), self.path(f"{self.root}/list-{v}"))
        self._clean(v)

    def _clean(self, version: int) -> None:
        """Delete lists before the last two and data neither of these names."""
        for n in self._lists():
            if n < version - 1:
                self.files.delete(self.path(f"{self.root}/list-{n}"), True)
        used = set(self.placed(version).values()) | set(self.placed(version - 1).values() if version > 1 else ())
        for s in self.files.listStatus(self.path(self.root)):
            name = s.getPath().getName()
            if name.startswith("data-") and int(name[5:]) not in used and int(name[5:]) < version:
                # data of an older write may still hold some buckets: only what no list names goes
                self.files.delete(s.getPath(), True)


def stream_update(spark: SparkSession, source: str, table: BucketTable, checkpoint: str, max_files: int = 100, failures: DataFrame | None = None) -> StreamingQuery:
    """Start a query that folds arriving Parquet files of raw index lines into a table of index records.

    A page must arrive within one file, as its last lines tell records from the resume key. failures
    (original_url, timestamp, digest, reason): records that failed for good are left out.
    """
    lines = spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files).parquet(source)

    def fold(batch: DataFrame, _: int) -> None:
        table.upsert(C.without_permanent(parsed(batch), failures, "original") if failures is not None else parsed(batch))

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_status(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of event types by event-time window; works on streams (append mode) and tables alike."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
