"""Fetching missing files: one task owns a digest, results fan out to its appearances.

A transport is a function url -> bytes or an iterator of pieces. Pieces go to a temporary file while both hashes
run, so no file is ever held as a whole; it takes its place in the store only if its SHA-1 is the one its digest
names. A sound blob that is there already is used instead of fetching.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.sources.capture_index import retry_after

MAX_BYTES = 2 * 1024**3
PIECE = 256 * 1024
#: More tries after answers of 429, each after the time the answer asks for.
PATIENCE = 4
SHA1_DIGEST = re.compile(r"[A-Za-z2-7]{32}")


class Rejected(Exception):
    """Bytes that no further try would mend."""


@dataclass
class Breaker:
    """Waits after so many failures with no file between them, within one task."""

    limit: int = 8
    pause: float = 90.0
    failures: int = 0

    def told(self, fine: bool) -> None:
        self.failures = 0 if fine else self.failures + 1
        if self.failures >= self.limit:
            time.sleep(self.pause)
            self.failures = 0


def sha1_name(raw: bytes) -> str:
    return base64.b32encode(raw).decode().lower()


def pieces(got: bytes | Iterable[bytes]) -> Iterator[bytes]:
    if isinstance(got, (bytes, bytearray)):
        for i in range(0, len(got), PIECE):
            yield bytes(got[i : i + PIECE])
    else:
        yield from got


def digests_of(path: str) -> tuple[str, str, int]:
    """(SHA-256, base32 SHA-1, size) of a file, read in pieces."""
    sha256, sha1, size = hashlib.sha256(), hashlib.sha1(), 0  # noqa: S324 - the archive's digests are SHA-1
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            sha256.update(piece)
            sha1.update(piece)
            size += len(piece)
    return sha256.hexdigest(), sha1_name(sha1.digest()), size


def sound_blob(path: str, digest: str, expected: str | None) -> tuple[str, int] | None:
    """(SHA-256, size) of a stored file whose hashes are those its digest and the database name."""
    if not os.path.isfile(path) or not os.path.getsize(path):
        return None
    sha256, sha1, size = digests_of(path)
    if SHA1_DIGEST.fullmatch(digest) and sha1 != digest.lower():
        return None
    if expected and expected.strip() and expected.strip().lower() != sha256:
        return None
    return sha256, size


def store(got: bytes | Iterable[bytes], path: str, digest: str) -> tuple[str, int]:
    """Write the pieces to path by way of a temporary file of this attempt; raises Rejected for wrong content."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"  # a second attempt of the task may run at the same time
    sha256, sha1, size = hashlib.sha256(), hashlib.sha1(), 0  # noqa: S324
    try:
        with open(part, "wb") as f:
            for piece in pieces(got):
                size += len(piece)
                if size > MAX_BYTES:
                    raise Rejected("file exceeds size limit")
                f.write(piece)
                sha256.update(piece)
                sha1.update(piece)
        if not size:
            raise Rejected("server returned an empty file")
        if SHA1_DIGEST.fullmatch(digest) and sha1_name(sha1.digest()) != digest.lower():
            raise Rejected("SHA-1 digest mismatch")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return sha256.hexdigest(), size


def fetch_one(url: str, path: str, digest: str, get: Callable, attempts: int = 3, pause: float = 2.0) -> tuple[str | None, int, str | None]:
    """(sha256, size, reason): store what is behind url at path, or say why not.

    429 is tried again up to PATIENCE times beside the attempts; other 4xx but 408 and wrong content aren't.
    """
    attempt, patience = 1, PATIENCE
    while True:
        try:
            return *store(get(url), path, digest), None
        except Rejected as e:
            return None, 0, str(e)
        except Exception as e:  # noqa: BLE001 - every failure becomes a row
            code = getattr(e, "code", None)
            reason = f"HTTP Error {code}: {getattr(e, 'reason', '')}" if code else f"{type(e).__name__}: {e}"
            if code == 429 and patience:
                patience -= 1
                time.sleep(retry_after((getattr(e, "headers", None) or {}).get("Retry-After"), 30))
                continue
            if attempt >= attempts or (code is not None and 400 <= code < 500 and code not in (408, 429)):
                return None, 0, reason
            time.sleep(pause * attempt)
            attempt += 1


def download(wanted: DataFrame, folder: str, get: Callable, partitions: int = 3, pace: float = 0.0, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """wanted (original_url, timestamp, digest[, expected_sha256]) to (..., sha256, size_bytes, store_path, reused, reason).

    One row per row of wanted. Every digest is fetched once, by one task, and not at all if its blob in the folder,
    which all executors share, is sound; `pace` seconds lie between two requests of a task.
    """
    if "expected_sha256" not in wanted.columns:
        wanted = wanted.withColumn("expected_sha256", F.lit(None).cast("string"))
    rows = wanted.withColumn("store_digest", values.store_digest("original_url", "timestamp", "digest"))
    one = rows.groupBy("store_digest").agg(F.min(F.struct("timestamp", "original_url")).alias("first"), F.max("expected_sha256").alias("expected"))
    todo = one.select("store_digest", F.col("first.original_url").alias("url"), "expected").repartition(partitions, "store_digest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for pdf in batches:
            out = []
            for digest, url, expected in zip(pdf["store_digest"], pdf["url"], pdf["expected"]):
                path = os.path.join(folder, digest[:2], digest)
                sound = sound_blob(path, digest, expected if isinstance(expected, str) else None)
                if sound:
                    out.append((digest, *sound, path, True, None))
                    continue
                sha, size, reason = fetch_one(url, path, digest, get, attempts, pause)
                breaker.told(sha is not None)
                out.append((digest, sha, size, path if sha else None, False, reason))
                time.sleep(pace)
            yield pd.DataFrame(out, columns=["store_digest", "sha256", "size_bytes", "store_path", "reused", "reason"])

    done = todo.mapInPandas(run, "store_digest string, sha256 string, size_bytes bigint, store_path string, reused boolean, reason string")
    return rows.join(done, "store_digest").drop("store_digest", "expected_sha256")
