"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20):
    """For what runs inside: Arrow batches of at most ``rows`` rows and about ``size`` bytes, so that a Python
    worker's memory follows the batch and not the partition. The session's own settings come back at the end."""
    values = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bounded(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Lowers the session's Arrow batches to these bounds, for plans that run after the call returns and read the
    settings then. Smaller settings stay; none is raised."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def parts_of(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, whatever the session's batch size is."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end, memory that the worker's allocators hold but do not use goes back to the system, since
    Spark keeps workers for later tasks."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set; a temporary folder
    in local mode, where all is one machine (tests); an error on a cluster without one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="ckpt-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: this cuts the lineage,
    and a lost executor costs only the tasks that were running on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id's decimal text leaves 2 modulo 4 (null ids: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def hash_sample(df: DataFrame, key: str, strata: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``strata`` (all where there are fewer), chosen by a
    hash of ``key``. One small aggregate sizes the fractions; the rows are filtered where they
    are read, so no text is shuffled."""
    counts = {r[0]: r[1] for r in df.filter(F.col(strata).isNotNull()).groupBy(strata).count().collect()}
    if not counts:
        return df.filter(F.lit(False))
    values = sorted(counts)
    below = F.map_from_arrays(F.lit(values), F.lit([int(1_000_000 * min(1.0, most / counts[v])) + 1 for v in values]))
    slot = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000))
    return df.filter(slot < F.try_element_at(below, F.col(strata)))
