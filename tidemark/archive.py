"""An archive folder as one object: captures, failures, reports, verification and updates as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import runtime, schema
from tidemark.content import binary
from tidemark.functions import urls, values
from tidemark.operators import captures as C
from tidemark.operators import download, reports
from tidemark.sources import archive_files


class Archive:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        runtime.ship(spark)

    def captures(self) -> DataFrame:
        return archive_files.load_captures(self.spark, self.folder)

    def failures(self) -> DataFrame:
        return archive_files.load_failures(self.spark, self.folder)

    def blobs(self) -> DataFrame:
        return archive_files.load_blobs(self.spark, self.folder)

    def reports(self) -> dict[str, DataFrame]:
        """The offline reports, lazily."""
        rows = self.captures()
        return {
            "timeline": C.timeline(rows),
            "latest_site": C.latest_site(rows),
            "versions": C.versions(rows),
            "extensions": C.extensions(rows),
            "totals": C.totals(rows),
            "documents": C.destinations(rows),
        }

    def write_reports(self) -> list[str]:
        """Write the reports that need the capture table and stored bytes only, and the overview; returns their paths."""
        rows, out = self.captures(), os.path.join(self.folder, "reports")
        scanned = self.blobs().select("digest", "content")
        docs = reports.is_document(rows)
        kind = urls.document_extension("original_url", "mimetype")
        one = C.dedup_by_digest(docs).select("digest", kind.alias("kind")).join(scanned, "digest")
        meta = runtime.written(one.select("digest", binary.document_metadata(F.col("content"), F.col("kind")).alias("r")).select("digest", "r.meta", "r.reason"), runtime.new_dir(self.spark, "meta"))
        flat = C.fan_out(docs.select("digest"), meta).select(*[F.try_element_at("meta", F.lit(n)).alias(n.lower()) for n in ("Author", "LastModifiedBy", "Manager", "Company")])
        made = {
            "timeline.txt": reports.timeline(rows),
            "single_captures.txt": reports.single_captures(rows),
            "documents.txt": reports.documents(docs, meta, C.people(flat)),
            "documents.csv": reports.documents_table(docs, meta),
            "integrity.txt": reports.integrity(self.verify()),
        }
        paths = []
        for name, lines in made.items():
            paths.append(os.path.join(out, name))
            reports.write(paths[-1], lines)
        overview = os.path.join(self.folder, "index.html")
        reports.write(overview, reports.dashboard(rows, archive_files.archive_domain(rows) or "", self.folder, paths))
        return [*paths, overview]

    def verify(self) -> DataFrame:
        """One row per digest with its status."""
        files = self.blobs().select("digest", "content")
        return binary.integrity(self.captures(), files)

    def repair_metadata(self) -> DataFrame:
        """Captures whose SHA-256 or size is missing or wrong although their file is sound, with both set; saved."""
        rows = self.captures()
        found = archive_files.file_hashes(self.blobs().select("digest", "path"))
        repaired = runtime.written(C.repaired(rows.withColumn("blob", values.store_digest("original_url", "timestamp", "digest")), found), runtime.new_dir(self.spark, "repair"))
        self._save(C.upsert(rows, repaired))
        return repaired

    def _save(self, rows: DataFrame) -> None:
        archive_files.save_table(rows, os.path.join(self.folder, "_database.csv"), schema.CAPTURE_COLUMNS)

    def retry_failed(self, get: Callable, first_seen: str) -> tuple[DataFrame, DataFrame]:
        """Try the queue's failures that aren't permanent once more; as update()."""
        rows = self.failures().filter(~C.is_permanent(F.col("reason")))
        return self.update(rows.select("original_url", "timestamp", "digest", "mimetype", "statuscode"), get, first_seen)

    def update(self, index: DataFrame, get: Callable, first_seen: str, **how) -> tuple[DataFrame, DataFrame]:
        """Fetch what the index has and the archive lacks; returns the new captures and failures, both saved.

        index: original_url, timestamp, digest, mimetype, statuscode. A blob counts as there if its hashes are right,
        which the download itself checks; sound ones aren't fetched again.
        """
        old, failed = self.captures(), self.failures()
        store = os.path.join(self.folder, "_store")
        os.makedirs(store, exist_ok=True)
        there = self.blobs().filter("length > 0").select("digest", "path")
        sound = archive_files.file_hashes(there).filter(~F.col("digest").rlike("^[A-Za-z2-7]{32}$") | (F.col("sha1") == F.lower("digest")))
        state = old.withColumn("store_path", values.store_digest("original_url", "timestamp", "digest"))
        # a blob is sound for a capture if it also has the SHA-256 the database gives
        known = state.select("store_path", F.lower(F.trim("sha256")).alias("want")).filter("want <> ''").groupBy("store_path").agg(F.min("want").alias("want"))
        good = sound.withColumnRenamed("digest", "store_path").join(known, "store_path", "left").filter("want is null or want = sha256").select("store_path")
        wanted = C.to_fetch(index, state, good, failed)
        done = runtime.written(download.download(wanted, store, get, **how), runtime.new_dir(self.spark, "update"))
        # new rows come after all old ones, so that 'first' keeps its meaning
        last = old.agg(F.coalesce(F.max("row_ord"), F.lit(0))).first()[0]
        place = F.lit(last + 1) + F.monotonically_increasing_id()
        new = done.filter(F.col("sha256").isNotNull()).withColumns({"size_bytes": F.col("size_bytes").cast("string"), "first_seen": F.lit(first_seen), "row_ord": place})
        new = runtime.written(new, runtime.new_dir(self.spark, "new"))
        behind = F.lit(failed.agg(F.coalesce(F.max("row_ord"), F.lit(0))).first()[0] + 1)
        bad = done.filter(F.col("sha256").isNull()).withColumns({"length": F.lit(""), "reason": C.marked_reason(F.col("reason")), "row_ord": behind + F.monotonically_increasing_id()})
        columns = [*schema.FAILURE_COLUMNS, "row_ord"]
        queue = runtime.written(C.merge_failures(failed.select(*columns), bad.select(*columns), new), runtime.new_dir(self.spark, "queue"))
        self._save(C.upsert(old, new))
        archive_files.save_table(queue, os.path.join(self.folder, "_failed_downloads.csv"), schema.FAILURE_COLUMNS)
        return new, queue
