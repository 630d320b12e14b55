"""The raw resource store (a Parquet table) and acquisition through a host's transport."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import identity
from quadloom.types import ACCESS_MODES, EngineError

STORED = "stable_id string, class string, bytes binary, digest string, content_type string, stored_at long"
RETRIED, LONGEST_WAIT_MS = (408, 429), 5000
#: Tasks that fetch from one origin at most.
SPREAD = 6
#: (status, bytes, headers) for a url; raises OSError where the exchange fails.
Transport = Callable[[str], tuple[int, bytes, dict]]


def exchange(transport: Transport, url: str, sleep: Callable[[float], None] = time.sleep) -> tuple[int | None, bytes | None]:
    """One exchange, repeated once after 408, 429, 5xx or a transport error; Retry-After is kept up to 5 s."""
    for attempt in (0, 1):
        headers: dict = {}
        try:
            status, body, headers = transport(url)
        except OSError:
            status, body = None, None
        again = status is None or status in RETRIED or status >= 500
        if not again or attempt:
            return status, body if status is not None and 200 <= status < 300 else None
        wait = {k.lower(): v for k, v in headers.items()}.get("retry-after", "0")
        sleep(min(LONGEST_WAIT_MS, max(0, int(wait) * 1000 if str(wait).isdigit() else 0)) / 1000)
    raise AssertionError


class RawStore:
    """Rows of STORED by (stable_id, class); each change writes a new version of the table, named by its time. A store
    that is opened again has the newest version that was written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        whole = [n for n in names if n.startswith("v") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
        self.version = max(whole, default=None)

    def read(self) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(f"{self.path}/{self.version}")

    def valid(self) -> DataFrame:
        """Entries whose digest is that of their bytes."""
        return self.read().filter(F.sha2("bytes", 256) == F.col("digest"))

    def write(self, rows: DataFrame) -> None:
        keys = ["stable_id", "class"]
        fresh = rows.select("stable_id", "class", "bytes", F.sha2("bytes", 256).alias("digest"), "content_type", F.unix_millis(F.current_timestamp()).alias("stored_at")).dropDuplicates(keys)
        self._next(self.read().join(fresh.select(*keys), keys, "left_anti").select(fresh.columns).unionByName(fresh))

    def remove(self, keys: DataFrame) -> None:
        self._next(self.read().join(keys.select("stable_id", "class").distinct(), ["stable_id", "class"], "left_anti"))

    def _next(self, rows: DataFrame) -> None:
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        self.version = version


def acquire(wanted: DataFrame, store: RawStore, transport: Transport | None, mode: str = "NORMAL") -> DataFrame:
    """wanted (stable_id, class, url) with bytes, digest, status and from_cache.

    NORMAL reads valid entries and fetches the rest, CACHE_ONLY never fetches, RELOAD always does. What was
    fetched is stored before anything can fail, so a failing batch keeps its valid parts. A resource is
    fetched once however often it is wanted.
    """
    if mode not in ACCESS_MODES:
        raise EngineError("RESOURCE_ACQUISITION_FAILED", f"unknown mode {mode}")
    keys = ["stable_id", "class"]
    once = wanted.select(*keys, "url").dropDuplicates(keys)
    have = store.valid().select(*keys, "bytes", "digest")
    cached = once.join(have, keys) if mode != "RELOAD" else once.join(have.limit(0), keys)
    hits = cached.select(*keys, "bytes", "digest", F.lit(200).alias("status"), F.lit(True).alias("from_cache"))
    absent = once.join(have.select(*keys), keys, "left_anti") if mode != "RELOAD" else once
    if mode == "CACHE_ONLY" or transport is None:
        lost = absent.select(*keys, F.lit(None).cast("binary").alias("bytes"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("status"), F.lit(False).alias("from_cache"))
        return wanted.join(hits.unionByName(lost), keys)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [exchange(transport, u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("stable_id"), b.column("class"), pa.array([g[1] for g in got], pa.binary()), pa.array([g[0] for g in got], pa.int32())], ["stable_id", "class", "bytes", "status"])

    origin = F.regexp_extract("url", "^[a-z]+://[^/]*", 0)
    fetched = absent.repartition(origin, F.pmod(F.xxhash64("stable_id"), F.lit(SPREAD))).mapInArrow(fetch, "stable_id string, class string, bytes binary, status int")
    fetched.write.parquet(path := f"{store.path}/fetched-{uuid.uuid4().hex}")
    fetched = store.spark.read.parquet(path)
    store.write(fetched.filter("bytes IS NOT NULL").withColumn("content_type", F.lit(None).cast("string")))
    new = fetched.select(*keys, "bytes", F.sha2("bytes", 256).alias("digest"), "status", F.lit(False).alias("from_cache"))
    return wanted.join(hits.unionByName(new), keys)


def stable_id(url) -> object:
    """A url's identity: its digest without the values of credentials."""
    return identity.sha256(identity.redacted(url))
