"""Best-fit packing by length patterns and non-negative least squares.

Documents become token pieces of at most ``size`` tokens. Only the histogram of piece lengths (at
most ``size`` counts) reaches the driver. There, patterns of two to four lengths that fill a sequence
are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded
down to what the histogram holds, and the residual histogram is packed best fit, longest first, whole
counts at a time. The plan is a list of (pattern, repeats) whose size depends on ``size`` alone. Each
piece finds its place from its length and its rank among the pieces of that length; ranks are
numbered per (length, bucket) plus the bucket's offset, so a length that a third of all pieces share is
spread over the buckets.

Defined results: null and empty texts are one token (the end mark); longer documents are cut into
full pieces, the first taking the remainder; equal rows are packed as rows of their own; an empty table
gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.bpe import ByteBPE, loaded
from llm.common import bounded, parts_of, released, shuffle_partitions, stored, table

SIZE, END = 2048, 0


def pieces_of(docs: DataFrame, path: str, size: int = SIZE, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit; null unless kept)."""
    bounded(docs.sparkSession)
    mark = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, ByteBPE)
        for b in parts_of(batches):
            out: list[list] = [[], [], [], [], [], []]
            for key, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = bpe.encode(t) + mark
                n = len(ids) // 4
                start, piece, length = 0, 0, n % size or size
                while start < n:
                    part = ids[4 * start : 4 * (start + length)]
                    for column, v in zip(out, (key, piece, start, length, zlib.crc32(part), part if keep_ids else None), strict=True):
                        column.append(v)
                    start, piece, length = start + length, piece + 1, size
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda batches: released(cut(batches)), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def patterns(present: np.ndarray, size: int, spread: int = 12) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a sequence exactly: all pairs, and the triples and
    quadruples whose first members are among ``spread`` lengths spread over those present."""
    has = np.zeros(size + 1, bool)
    has[present] = True
    found = [(a, size - a, 0, 0) for a in present if a <= size - a and has[size - a]]
    some = np.unique(present[np.linspace(0, len(present) - 1, min(spread, len(present))).astype(int)])
    for a in some:
        found += [(a, b, size - a - b, 0) for b in present if b <= size - a - b and has[size - a - b]]
        found += [(a, b, c, size - a - b - c) for b in some if b >= a for c in present if b <= c <= size - a - b - c and has[size - a - b - c]]
    return np.unique(np.array(found, np.int64).reshape(-1, 4), axis=0)


def fit(rows: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares of the patterns' repeats against the counts, by accelerated
    projected gradient steps."""
    x = y = np.zeros(len(rows))
    t, used = 1.0, rows > 0
    overlap = np.bincount(rows[used], minlength=len(counts)).max(initial=1) * 4 + 1

    def residual(z: np.ndarray) -> np.ndarray:
        made = np.bincount(rows.ravel(), weights=np.repeat(z, 4), minlength=len(counts))
        made[0] = 0
        return made - counts

    for _ in range(steps):
        step = np.maximum(0, y - (residual(y)[rows] * used).sum(axis=1) / overlap)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = step + (t - 1) / t_next * (step - x), step, t_next
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, repeats) that use up the histogram exactly."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []
    if left[size]:
        out.append(([size], int(left[size])))
        left[size] = 0
    rows = patterns(np.flatnonzero(left), size) if left.any() else np.zeros((0, 4), np.int64)
    if len(rows):
        x = fit(rows, left.astype(float))
        for k in np.argsort(-x, kind="stable"):
            lengths = [int(a) for a in rows[k] if a]
            n = min([int(np.floor(x[k] + 0.5)), *(int(left[a]) // lengths.count(a) for a in set(lengths))])
            if n > 0:
                out.append((lengths, n))
                for a in lengths:
                    left[a] -= n
    return out + best_fit(left, size)


def best_fit(left: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, over whole counts: bins with equal contents are one group."""
    room: list[list[tuple[list[int], int]]] = [[] for _ in range(size + 1)]
    for length in range(size, 0, -1):
        n, at = int(left[length]), length
        while n and at <= size:
            if not room[at]:
                at += 1
                continue
            lengths, bins = room[at].pop()
            fill = min(bins, n)
            if bins > fill:
                room[at].append((lengths, bins - fill))
            room[at - length].append(([*lengths, length], fill))
            n -= fill
            at = length  # what was just filled may be the tightest again
        each = size // length
        for copies, bins in ((each, n // each), (n % each, 1)):
            if copies and bins:
                room[size - copies * length].append(([length] * copies, bins))
    return [g for groups in room for g in groups]


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = pieces.sparkSession
    n = shuffle_partitions(spark)
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    keys, bases, offsets, first, sequence = [], [], [], {}, 0
    for lengths, repeats in plan(counts, size):
        at = 0
        for length in lengths:
            taken = first.get(length, 0)
            keys.append((length << 40) + taken)
            bases.append(sequence - taken)
            offsets.append(at)
            first[length] = taken + repeats
            at += length
        sequence += repeats
    order = np.argsort(np.array(keys, np.int64))
    key, base, offset = (np.array(v, np.int64)[order] for v in (keys, bases, offsets))

    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    sizes = bucketed.groupBy("length", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = bucketed.withColumn("rank", within).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("bucket", "before")
    columns = pieces.columns
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(base[k] + rank if len(k) else rank, pa.int64()), pa.array(offset[k] if len(k) else rank, pa.int64())], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """Tokenizes each document once, into the shared folder, and packs the pieces."""
    return pack(stored(pieces_of(docs, path, size, keep_ids=keep_ids), "pieces"), size)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
