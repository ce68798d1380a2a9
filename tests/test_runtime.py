import os
import time

import pytest

from tidemark import runtime


class Session:
    """A session without spark.checkpoint.dir."""

    def __init__(self):
        self.conf, self.sparkContext = {}, self
        self.checkpoints, self.master = [], "local[2]"

    def setCheckpointDir(self, path):
        self.checkpoints.append(path)


def test_shared_dir_without_setting():
    s = Session()
    path = runtime.shared_dir(s)
    assert os.path.isdir(path) and runtime.shared_dir(s) == path and s.checkpoints == [path]
    s.conf = {"spark.checkpoint.dir": "file:///shared"}
    assert runtime.shared_dir(s) == "file:///shared"
    cluster = Session()
    cluster.master = "spark://host:7077"
    with pytest.raises(ValueError, match="share"):
        runtime.shared_dir(cluster)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(rows, how):
    big = rows("k bigint, v bigint", *[(1 if i % 3 else i, i) for i in range(60)], (None, 7))
    small = rows("k bigint, w string", (1, "a"), (3, "b"), (99, "c"))
    want = sorted(map(str, runtime.join_small(big, small, ["k"], how).collect()))
    for salt in (0, 5):
        assert sorted(map(str, runtime.join_small(big, small, ["k"], how, rows=0, salt=salt).collect())) == want


def test_written_tables(spark, rows):
    path = runtime.new_dir(spark, "t")
    assert runtime.written(rows("a bigint"), path).count() == 0
    assert runtime.fits(rows("a bigint", (1,), (2,)), 2) and not runtime.fits(rows("a bigint", (1,), (2,)), 1)


def test_shuffle_files_go_with_the_write(spark):
    """A table on the way leaves nothing of its shuffle on disk, however much memory the driver has; the setting is as before."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    before, setting = files(), spark.conf.get(runtime.CLEANUP, None)
    out = runtime.written(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count(), runtime.new_dir(spark, "t"))
    assert out.count() == 700
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.1)
    left = {f for f in files() - before if f.endswith(".data") and os.path.getsize(f) > 2000}
    assert not left and spark.conf.get(runtime.CLEANUP, None) == setting
    path = runtime.new_dir(spark, "t")
    runtime.written(spark.range(3), path)
    runtime.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
