"""Session helpers shared by all operators: shared folder, table access, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side up to which it is broadcast; its byte bound is this times the row width (keys only).
BROADCAST_ROWS = 100_000
#: Spark's setting by which a finished job's shuffle files are deleted at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset in a local session, a new temporary one.

    Raises where it is unset on a cluster: what one machine writes to its own disk others can't read.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext  # the setting can't be changed in a running session
    if not getattr(sc, "_tidemark_shared", None):
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc._tidemark_shared = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, sc._tidemark_shared, True)
        sc.setCheckpointDir(sc._tidemark_shared)
    return sc._tidemark_shared


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, in this application's part of it, which goes when the driver ends."""
    return os.path.join(session_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    sc = spark.sparkContext
    root = os.path.join(shared_dir(spark), f"tidemark-{sc.applicationId}")
    if getattr(sc, "_tidemark_session", None) != root:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
        sc._tidemark_session = root
    return root


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Arrow functions can import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    here = Path(__file__).parent
    path = new_dir(spark, "code").removeprefix("file://").removeprefix("file:")
    if "://" in path:  # no file system of this machine; the driver serves the archive to the executors itself
        path = tempfile.mkdtemp(prefix="tidemark-code-")
        atexit.register(shutil.rmtree, path, True)
    os.makedirs(path, exist_ok=True)
    archive = os.path.join(path, "tidemark_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(archive)
    sc._tidemark_shipped = True


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each ends, not when the driver's garbage happens to be collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to path as Parquet and read it back: cuts the lineage and survives lost executors."""
    w = df.write.mode("overwrite")
    with tidy(df.sparkSession):
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most this many rows (counts no further than needed)."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salt: int = 0) -> DataFrame:
    """Join big to small: small is broadcast if it has at most `rows` rows, else both sides are shuffled.

    With salt > 1 the shuffled form spreads each key of big over `salt` partitions and repeats small as
    often, so that one hot key never ends in one task. `how` must keep only rows of big (inner, left,
    left_semi, left_anti).
    """
    if fits(small, rows):
        return big.join(F.broadcast(small), on, how)
    if salt > 1:
        s = "__salt"
        left = big.withColumn(s, F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salt)).cast("int"))
        right = small.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        return left.join(right, [*on, s], how).drop(s)
    return big.join(small, on, how)
