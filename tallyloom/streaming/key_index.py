"""Which event keys of a tenant are stored, for good: keys in buckets by hash, and a Bloom filter for each of their files."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.files import Folder

KEY = ["tenant_id", "event_uid"]
PLACE = ["tenant_id", "bucket"]
#: Buckets of a tenant. A look-up brings the new keys of one bucket together, and a filter takes BITS a key.
BUCKETS, BITS, PROBES = 64, 24, 16
#: Commits of about one size before they are merged, and files that are read one by one before all are scanned.
COMMITS, FILES_AT_ONCE = 8, 10_000
_FILTERS = "tenant_id int, bucket int, keys long, bits binary"


def bucket_of(key: str = "event_uid") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _positions(keys: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key (a row a key). Keys are digests already; a second number comes from mixing them."""
    first = keys.astype(np.uint64)
    second = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((first[:, None] + steps * second[:, None]) >> np.uint64(3)) % np.uint64(size)


def filter_bits(keys: np.ndarray) -> bytes:
    size = max(64, -(-len(keys) * BITS // 8) * 8)
    bits = np.zeros(size, bool)
    bits[_positions(keys, size).reshape(-1)] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_positions(keys, len(held))].all(axis=1)


class KeyIndex:
    """Stored keys below ``path``.

    A commit writes the keys of the buckets it touches, then a filter for each; it counts once these are complete. A look-up
    reads the filters of touched tenants and buckets, and then only the files of which a filter does not rule out all keys.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def commits(self) -> list[str]:
        names = [n for n in self.folder.names("filters") if n.startswith("commit=")]
        return [n[7:] for n in names if self.folder.exists(f"filters/{n}/_SUCCESS")]

    def _filters(self, commits: list[str]) -> DataFrame:
        paths = [f"{self.folder.path}/filters/commit={c}" for c in commits]
        return self.spark.read.option("basePath", f"{self.folder.path}/filters").schema(f"{_FILTERS}, commit string").parquet(*paths)

    def add(self, keys: DataFrame, commit: str) -> None:
        """Store ``tenant_id, event_uid`` rows under a commit; an earlier attempt of the same is replaced."""
        self.folder.delete(f"filters/commit={commit}")
        placed = keys.select(F.col("tenant_id").cast("int").alias("tenant_id"), F.col("event_uid").cast("long").alias("event_uid")).distinct().withColumn("bucket", bucket_of())
        placed.repartition(*PLACE).sortWithinPartitions(*PLACE, "event_uid").write.mode("overwrite").partitionBy(*PLACE).parquet(f"{self.folder.path}/keys/commit={commit}")

        def condense(place: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"tenant_id": [place[0]], "bucket": [place[1]], "keys": [len(rows)], "bits": [filter_bits(rows["event_uid"].to_numpy())]})

        if self.folder.files(f"keys/commit={commit}"):
            stored = self.spark.read.schema("event_uid long, tenant_id int, bucket int").parquet(f"{self.folder.path}/keys/commit={commit}")
        else:
            stored = placed.limit(0)
        stored.groupBy(*PLACE).applyInPandas(condense, _FILTERS).write.mode("overwrite").parquet(f"{self.folder.path}/filters/commit={commit}")

    def remove(self, commit: str) -> None:
        self.folder.delete(f"filters/commit={commit}")
        self.folder.delete(f"keys/commit={commit}")

    def stored(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """Those of ``keys`` (``tenant_id, event_uid``) that a commit other than ``but`` has stored."""
        asked = keys.select(*KEY).distinct().withColumn("bucket", bucket_of())
        commits = [c for c in self.commits() if c != but]
        if not commits:
            return asked.select(*KEY).limit(0)

        def sift(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            uids = rows["event_uid"].to_numpy()
            hits = [(c, may_hold(bits, uids)) for c, bits in zip(filters["commit"], filters["bits"], strict=True)] if len(rows) else []
            found = [rows.assign(commit=c)[hit] for c, hit in hits if hit.any()]
            return pd.concat(found) if found else rows.assign(commit="")[:0]

        touched = asked.select(*PLACE).distinct()
        filters = self._filters(commits).join(touched, PLACE, "left_semi")
        made = f"tenant_id {dict(asked.dtypes)['tenant_id']}, event_uid long, bucket int, commit string"
        maybe = asked.groupBy(*PLACE).cogroup(filters.groupBy(*PLACE)).applyInPandas(sift, made).persist()
        files = maybe.select("commit", *PLACE).distinct().limit(FILES_AT_ONCE + 1).collect()
        base = f"{self.folder.path}/keys"
        reader = self.spark.read.option("basePath", base).schema("event_uid long, commit string, tenant_id int, bucket int")
        if not files:
            return asked.select(*KEY).limit(0)
        if len(files) <= FILES_AT_ONCE:
            held = reader.parquet(*(f"{base}/commit={r['commit']}/tenant_id={r['tenant_id']}/bucket={r['bucket']}" for r in files))
        else:
            held = reader.parquet(*(f"{base}/commit={c}" for c in commits))
        return maybe.select(*KEY, "commit", "bucket").join(held, ["commit", "bucket", *KEY], "left_semi").select(*KEY).distinct()

    def merge_commits(self, but: str | None = None) -> int:
        """Bring COMMITS commits of about one size together, if there are so many; returns how many were.

        Each key is thus written anew a logarithmic number of times. The merged commit is complete before the others go, and a
        key that is stored twice for a while does no harm.
        """
        commits = [c for c in self.commits() if c != but]
        if len(commits) < COMMITS:
            return 0
        sizes = {r["commit"]: r["keys"] for r in self._filters(commits).groupBy("commit").agg(F.sum("keys").alias("keys")).collect()}
        alike: dict[int, list[str]] = {}
        for c in commits:
            alike.setdefault(int(np.log2(sizes.get(c, 0) + 1) // np.log2(COMMITS)), []).append(c)
        for _, group in sorted(alike.items()):
            if len(group) >= COMMITS:
                base = f"{self.folder.path}/keys"
                paths = [f"{base}/commit={c}" for c in group if self.folder.exists(f"keys/commit={c}")]
                self.add(self.spark.read.option("basePath", base).schema("event_uid long, commit string, tenant_id int, bucket int").parquet(*paths), f"merged-{uuid.uuid4().hex}")
                for c in group:
                    self.remove(c)
                return len(group)
        return 0
