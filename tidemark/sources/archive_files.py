"""Readers and writers of an archive folder.

Spark hides files whose name starts with an underscore: a CSV table `_database.csv` read by spark.read gives no
rows and no error. load_table() therefore hands Spark a path it doesn't hide, and load_blobs() takes the store
itself as root.
"""

from __future__ import annotations

import csv
import json
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import runtime, schema

BATCH = 50_000


def load_table(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV table (UTF-8 with or without mark, header, quotes doubled) as strings plus row_ord.

    Columns are taken by name; missing ones are '', others are dropped. A missing file is an empty table. The
    file is streamed in batches into Parquet in the shared folder, never held as a whole.
    """
    out = runtime.new_dir(spark, "table")
    fields = pa.schema([("row_ord", pa.int64()), *((c, pa.string()) for c in columns)])
    os.makedirs(local(out), exist_ok=True)
    import pyarrow.parquet as pq

    with pq.ParquetWriter(os.path.join(local(out), "part-0.parquet"), fields) as writer:
        rows: list[list[str]] = []
        n = 0
        for n, row in enumerate(_csv_rows(path, columns), 1):
            rows.append([n, *row])
            if len(rows) == BATCH:
                writer.write_table(_table(rows, fields))
                rows = []
        if rows or not n:
            writer.write_table(_table(rows, fields))
    return spark.read.parquet(out)


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _table(rows: list[list], fields: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def _csv_rows(path: str, columns: tuple[str, ...]) -> Iterator[list[str]]:
    if not os.path.isfile(path):
        return
    with open(path, encoding="utf-8-sig", newline="") as f:
        for row in csv.DictReader(f):
            yield [row.get(c) or "" for c in columns]


def load_captures(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, os.path.join(folder, "_database.csv"), schema.CAPTURE_COLUMNS)


def load_failures(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, os.path.join(folder, "_failed_downloads.csv"), schema.FAILURE_COLUMNS)


def load_blobs(spark: SparkSession, folder: str, max_bytes: int = 2**31 - 1024) -> DataFrame:
    """(digest, path, length, content) of the stored files.

    No JVM array holds more than max_bytes, so a larger file has a NULL content; its length tells it from a missing one,
    and file_hashes() reads it in pieces.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(os.path.join(folder, "_store"))
    digest = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(digest.alias("digest"), "path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def file_hashes(files: DataFrame) -> DataFrame:
    """files (digest, path) to (digest, sha256, sha1, size) by reading them in pieces, whatever their size.

    path must be readable on every executor. A file that can't be read has NULL hashes.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from tidemark.operators import download

        for pdf in batches:
            out = []
            for digest, path in zip(pdf["digest"], pdf["path"]):
                try:
                    out.append((digest, *download.digests_of(local(path))))
                except OSError:
                    out.append((digest, None, None, None))
            yield pd.DataFrame(out, columns=["digest", "sha256", "sha1", "size"]).astype({"size": "Int64"})

    return files.select("digest", "path").mapInPandas(run, "digest string, sha256 string, sha1 string, size bigint")


def read_manifest(path: str) -> dict:
    """The manifest's values, none if it is missing or damaged."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (ValueError, OSError):
        return {}
    return data if isinstance(data, dict) else {}


def archive_domain(captures: DataFrame) -> str | None:
    """Host of the first capture with an address."""
    from tidemark.functions import urls

    first = captures.filter(F.trim("original_url") != "").agg(F.min_by(urls.domain("original_url"), "row_ord")).first()[0]
    return first or None


def save_table(rows: DataFrame, path: str, columns: tuple[str, ...], order: str = "row_ord") -> None:
    """Write a CSV table in row order through a temporary file and an atomic rename; rows stream to the driver."""
    temporary = f"{path}.part"
    with open(temporary, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(columns)
        for r in rows.orderBy(order).select(*columns).toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def save_raw_pages(lines: DataFrame, path: str) -> None:
    """Raw index lines, one folder a page."""
    lines.select("page_no", F.col("raw").alias("value")).write.mode("overwrite").partitionBy("page_no").text(path)


def save_manifest(totals: DataFrame, path: str, settings: dict) -> dict:
    """Write totals (one row) and settings as JSON; archive_created of an earlier manifest is kept."""
    old = read_manifest(path)
    data = {"schema_version": 2, **settings, **totals.first().asDict()}
    if old.get("archive_created"):
        data["archive_created"] = old["archive_created"]
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.part", path)
    return data


def materialize(view: DataFrame, store: str, target: str) -> DataFrame:
    """Put stored files at their places: view (digest, rel_path[, wrapped]) to (rel_path, written BOOLEAN).

    Files whose row says wrapped hold a gzip transfer encoding and are written unpacked, in pieces.
    """
    if "wrapped" not in view.columns:
        view = view.withColumn("wrapped", F.lit(False))

    def run(batches: Iterator) -> Iterator:
        import gzip
        import uuid

        import pandas as pd

        for pdf in batches:
            done = []
            for digest, rel, wrapped in zip(pdf["digest"], pdf["rel_path"], pdf["wrapped"]):
                source, dest = os.path.join(store, digest[:2], digest), os.path.join(target, rel)
                part = f"{dest}.{uuid.uuid4().hex[:8]}.part"
                try:
                    os.makedirs(os.path.dirname(dest), exist_ok=True)
                    with (gzip.open if wrapped else open)(source, "rb") as a, open(part, "wb") as b:
                        shutil.copyfileobj(a, b, 1 << 20)
                    os.replace(part, dest)
                    done.append(True)
                except (OSError, EOFError):
                    if os.path.exists(part):
                        os.remove(part)
                    done.append(False)
            yield pd.DataFrame({"rel_path": pdf["rel_path"], "written": done})

    return view.select("digest", "rel_path", "wrapped").mapInPandas(run, "rel_path string, written boolean")
