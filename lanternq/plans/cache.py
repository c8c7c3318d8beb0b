"""Results kept as Parquet below a folder, with a record of what is there."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "key string, stored_at double, kind string, rows bigint"


def key_of(kind: str, **parts) -> str:
    """The same for the same parts in any order."""
    text = json.dumps({"kind": kind, **{k: sorted(v) if isinstance(v, list | set | tuple) else v for k, v in parts.items()}}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def corpus_state(files: DataFrame) -> str:
    """Changes with any file's path and time of change, or its content if no time is known."""
    what = "mtime" if "mtime" in files.columns else "content"
    mark = F.xxhash64("path", F.coalesce(F.col(what).cast("string"), F.lit("")))
    row = files.agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(mark, 24)).alias("s")).first()
    return f"{row.n}:{row.x}:{row.s}"


class Cache:
    """Each entry has a folder of its own with its record beside it, so that no
    write or deletion touches other entries; the record goes first."""

    def __init__(self, spark: SparkSession, folder: str, ttl_seconds: float = 3600, clock=time.time):
        self.spark, self.folder, self.ttl, self.clock = spark, folder.rstrip("/"), ttl_seconds, clock
        self.hits = self.misses = 0

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def meta(self) -> DataFrame:
        p, fs = self._path(f"{self.folder}/meta")
        if not fs.exists(p) or not len(fs.listStatus(p)):
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).json(f"{self.folder}/meta/*")

    def put(self, key: str, df: DataFrame, kind: str = "general") -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/data/{key}")
        rows = self.spark.read.parquet(f"{self.folder}/data/{key}").count()
        record = self.spark.createDataFrame([(key, float(self.clock()), kind, rows)], META)
        record.coalesce(1).write.mode("overwrite").json(f"{self.folder}/meta/{key}")

    def get(self, key: str) -> DataFrame | None:
        """The table, if it is there and not older than the time to live."""
        last = self.meta().filter(F.col("key") == key).agg(F.max("stored_at").alias("t")).first().t
        if last is None or self.clock() - last >= self.ttl or not self._exists(f"{self.folder}/data/{key}"):
            self.misses += 1
            return None
        self.hits += 1
        return self.spark.read.parquet(f"{self.folder}/data/{key}")

    def latest(self, kind: str, within_seconds: float) -> str | None:
        """The key of the newest entry of a kind, if it is as young as that."""
        newest = self.meta().filter(F.col("kind") == kind).agg(F.max_by("key", "stored_at").alias("key"), F.max("stored_at").alias("t")).first()
        return newest.key if newest.t is not None and self.clock() - newest.t < within_seconds else None

    def kept(self, key: str, kind: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The entry, built and stored first if it is not there."""
        found = self.get(key)
        if found is None:
            self.put(key, build(), kind)
            found = self.spark.read.parquet(f"{self.folder}/data/{key}")
        return found

    def _drop(self, keys: list[str]) -> int:
        for key in keys:
            self._delete(f"{self.folder}/meta/{key}")
            self._delete(f"{self.folder}/data/{key}")
        return len(keys)

    def clear(self, kind: str | None = None) -> int:
        rows = self.meta().filter(F.col("kind") == kind) if kind else self.meta()
        return self._drop([r.key for r in rows.select("key").distinct().collect()])

    def cleanup(self) -> int:
        rows = self.meta().groupBy("key").agg(F.max("stored_at").alias("t"))
        return self._drop([r.key for r in rows.filter(is_expired(F.col("t"), F.lit(self.clock()), self.ttl)).collect()])

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "hit_rate": 100.0 * self.hits / asked if asked else 0.0, "entries": self.meta().select("key").distinct().count()}


def is_expired(stored_at: Column, now: Column, ttl_seconds: float) -> Column:
    return now - stored_at > ttl_seconds
