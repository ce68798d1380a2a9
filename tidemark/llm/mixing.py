"""Problem 9: mixing sources to target shares of tokens.

Weighted fair queueing. Each source is a flow whose weight is its target share; its documents, shuffled anew
in every pass, are its packets. A document's virtual finish time is the tokens of its source up to and
including it, divided by the weight. All documents are range-sorted by finish time and cut off at the budget,
so every prefix of the result has the target shares as far as the sources last. A source may be passed through
max_repeat times; what it can't fill goes to the others in proportion to their weights.

Running sums never put a source in one task: documents fall into buckets of the shuffle key (later: of the
finish time), the buckets' sums are summed up, and a window runs inside each bucket only.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import runtime

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to that vocabulary (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BUCKET_ROWS = 20_000


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs plus tokens BIGINT, the length of `text` in tokens of the vocabulary at that path; NULL counts 0."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        for s in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return docs.withColumn("tokens", count("text"))


def virtual_end(flows: list[dict], budget: int) -> float:
    """Virtual time at which the flows together have sent the budget (or all they may send)."""
    left = sorted(flows, key=lambda f: f["cap"] / f["share"])
    sent, weight = 0.0, sum(f["share"] for f in left)
    for f in left:
        end = f["cap"] / f["share"]
        if sent + weight * end >= budget:
            return (budget - sent) / weight
        sent += f["cap"]
        weight -= f["share"]
    return max((f["cap"] / f["share"] for f in left), default=0.0)


def running_sum(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows plus the sum of value up to and including each row, by group in the order of (bucket, *order)."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("__s"))
    # one row per bucket of BUCKET_ROWS rows
    before = sums.withColumn("__before", F.sum("__s").over(Window.partitionBy(*group).orderBy(bucket)) - F.col("__s")).drop("__s")
    inside = F.sum(value).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runtime.join_small(rows.withColumn("__in", inside), before, [*group, bucket]).withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before")


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 42) -> DataFrame:
    """docs (id, source, tokens) drawn to targets (source, target_share, max_repeat).

    Returns (id, source, copy, tokens, finish, total): one row per use of a document in the order of the mix
    (finish, then source, id, copy), total = tokens up to and including it, at most the budget. The default
    budget is the tokens of all documents of the target sources. Documents of other or NULL sources and without
    tokens aren't used; targets without share or repeats, and repeated targets but the first, don't count.
    Ties of the shuffle are broken by id, repeated rows are used each on its own. No documents give no rows.
    """
    spark = docs.sparkSession
    root = runtime.new_dir(spark, "mix")
    wanted = targets.filter((F.col("target_share") > 0) & (F.col("max_repeat") > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeat").alias("repeats"))
    sized = docs.select("id", "source", "tokens").filter(F.col("tokens") > 0).transform(lambda rows: runtime.join_small(rows, wanted, ["source"], salt=16))
    sized = runtime.written(sized, f"{root}/sized")
    per = [r.asDict() for r in sized.groupBy("source", "share", "repeats").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum")).collect()]  # one row per target source
    for f in per:
        f["cap"] = f["sum"] * f["repeats"]
    budget = budget if budget is not None else sum(f["sum"] for f in per)
    end = virtual_end(per, budget)
    # a pass more than the end needs, since documents aren't fluid
    flows = [(f["source"], min(f["repeats"], math.ceil(f["share"] * end / f["sum"]) + 1), float(f["sum"]), max(1, f["n"] // BUCKET_ROWS)) for f in per]
    plan = F.broadcast(spark.createDataFrame(flows, "source string, passes int, per_pass double, buckets bigint"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", "copy"), 1)
    copies = sized.join(plan, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("key", key)
    copies = copies.withColumn("bucket", F.least(F.floor(F.col("key") / F.lit(float(2**63)) * F.col("buckets")), F.col("buckets") - 1))
    summed = running_sum(copies, ["source", "copy"], "bucket", ["key", "id"], "tokens", "sent")
    timed = summed.withColumn("finish", (F.col("copy") * F.col("per_pass") + F.col("sent")) / F.col("share")).select("id", "source", "copy", "tokens", "finish")
    timed = runtime.written(timed, f"{root}/timed")
    rows = timed.count()
    span = max(1, rows // BUCKET_ROWS)
    limit = end + 1.0
    slot = F.least(F.floor(F.col("finish") / F.lit(limit) * span), F.lit(span))
    out = running_sum(timed.withColumn("slot", slot).withColumn("all", F.lit(0)), ["all"], "slot", ["finish", "source", "id", "copy"], "tokens", "total")
    out = out.filter(F.col("total") <= budget).select("id", "source", "copy", "tokens", "finish", "total")
    return out.orderBy("finish", "source", "id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Reached against wanted shares: (source, target_share, max_repeat, documents, uses, tokens, actual_share)."""
    by = mixed.groupBy("source").agg(F.count_distinct("id").alias("documents"), F.count("*").alias("uses"), F.sum("tokens").alias("tokens"), F.max(F.col("copy") + 1).alias("most_uses"))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target source
    out = targets.join(by, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return out.select("source", "target_share", "max_repeat", zero("documents"), zero("uses"), zero("most_uses"), zero("tokens"), F.coalesce(F.col("tokens") / everything, F.lit(0.0)).alias("actual_share"))
