"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors become integer rows (floor of 1024 x). Queries and candidates are packed into blocks of
bounded size, by rows and by bytes, in the narrowest integers that hold them. Both are dealt out over a grid of cells, candidate
blocks to all cells of a row and query blocks to all cells of a column, by a shuffle and never through the driver; so each query
block meets each candidate block once, in a task that walks the terms
(dimensions with a non-zero query weight), scatters weight times posting into a dense score array,
selects the k best of the block, and passes on only those. The k best of each query row are then
merged from the blocks' lists.

Defined results: a null vector, an empty one, one holding a null or non-finite component, and one with a null id take
no part; vectors of different lengths are compared as sparse rows, missing terms being 0; ties go to the smaller id. Rows
are told apart even where they repeat an id: each is a candidate of its own (also of other rows with its id), each
query row has a list of its own, and only the row itself is left out of it. Fewer than k candidates give fewer rows; a
score outside 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import dropped, parts_of, shuffle_partitions, stored

SCALE = 1024
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: No block's matrix is larger, but for a single row.
BLOCK_BYTES = 16 << 20


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows and ``BLOCK_BYTES``, from as many Arrow batches as it takes: ids, numbers that
    tell all rows apart, and the dense integer matrix, as bytes of ``width`` each number."""

    def block(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        m = np.zeros((len(held), max(len(v) for _, _, v in held)), np.int64)
        for i, (_, _, v) in enumerate(held):
            m[i, : len(v)] = v
        ids, own = (np.array([h[k] for h in held], np.int64).tobytes() for k in (0, 1))
        width = next(w for w in (2, 4, 8) if w == 8 or (abs(int(m.min())) < 1 << 8 * w - 1 and abs(int(m.max())) < 1 << 8 * w - 1))
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in (ids, own, m.astype(f"i{width}").tobytes())), pa.array([width], pa.int32())], ["ids", "own", "m", "width"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[int, int, np.ndarray]] = []
        longest = 0
        for b in parts_of(batches, most):
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            own = b.column("own").to_numpy(zero_copy_only=False) if "own" in b.schema.names else number + np.arange(b.num_rows)
            number += b.num_rows
            lists = b.column("v")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(b.num_rows):
                v = flat[ends[i] : ends[i + 1]]
                if held and (len(held) == most or (len(held) + 1) * max(longest, len(v)) * 8 > BLOCK_BYTES):
                    yield block(held)
                    held, longest = [], 0
                held.append((int(ids[i]), int(own[i]), v))
                longest = max(longest, len(v))
        if held:
            yield block(held)

    return rows.mapInArrow(pack, "ids binary, own binary, m binary, width int")


def matrix(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"i{width}").reshape(rows, -1).astype(np.int64)


def asking(blocks: DataFrame, every: int) -> DataFrame:
    """The rows of the blocks whose id is divisible by ``every``: vec_id, own, v."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1):
            ids, own = (np.frombuffer(b.column(c)[0].as_py(), np.int64) for c in ("ids", "own"))
            m = matrix(b.column("m")[0].as_py(), b.column("width")[0].as_py(), len(ids))
            at = np.flatnonzero(ids % every == 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own[at]), pa.array(list(m[at]), pa.list_(pa.int64()))], ["vec_id", "own", "v"])

    return blocks.mapInArrow(take, "vec_id long, own long, v array<long>")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def accumulate(q: np.ndarray, x: np.ndarray, highest: float | None = None) -> np.ndarray:
    """Scores of one sparse query row against all rows of x, term by term. Where a sum could pass 64 bits, high and
    low halves of the products are added up apart. highest: the largest absolute value in x, where it is known."""
    terms = np.flatnonzero(q[: x.shape[0]])
    if highest is None:
        highest = float(np.abs(x).max(initial=0))
    most = float(np.abs(q).max(initial=0)) * highest * max(1, x.shape[0])
    if most < 2**62:
        small = 0 < highest and most < 2**31 and x.dtype == np.int32  # then the sums fit too
        scores = np.zeros(x.shape[1], np.int32 if small else np.int64)
        for t in terms:
            scores += (np.int32(q[t]) if small else q[t]) * (x[t] if small else x[t].astype(np.int64, copy=False))
        return scores.astype(np.int64, copy=False)
    exact = np.zeros(x.shape[1], object)
    for t in terms:
        exact += x[t].astype(object) * int(q[t])
    return exact.astype(np.int64)  # raises OverflowError beyond 64 bits


def grid(cells: int, candidates: int, queries: int) -> tuple[int, int]:
    """Rows and columns of about so many cells, for the least to send: candidates go to every column, queries to every row."""
    columns = max(1, min(cells, round((cells * queries / max(1, candidates)) ** 0.5)))
    return -(-cells // columns), columns


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``."""
    n = shuffle_partitions(vectors.sparkSession)
    blocks = stored(packed(usable(vectors, vec_id, embedding), CANDIDATE_BLOCK), "topk-candidates")
    asked = stored(asking(blocks, every), "topk-asked")
    queries = stored(packed(asked.repartition(max(1, -(-asked.count() // QUERY_BLOCK))), QUERY_BLOCK), "topk-queries")
    rows, columns = grid(n, *(x.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] for x in (blocks, queries)))
    place = lambda over: F.pmod(F.xxhash64("own"), F.lit(over))
    every_of = lambda over: F.explode(F.sequence(F.lit(0), F.lit(over - 1)))
    sent = queries.select(*(F.col(c).alias(f"q_{c}") for c in ("ids", "own", "m", "width")), place(columns).alias("column"), every_of(rows).alias("row"))
    slotted = blocks.select("*", place(rows).alias("row"), every_of(columns).alias("column"))
    cell = (F.col("row") * columns + F.col("column")).cast("int").alias("slot")
    pairs = slotted.select("ids", "own", "m", "width", cell).join(sent.select("q_ids", "q_own", "q_m", "q_width", cell).hint("merge"), "slot")  # every query block once with every candidate block; a broadcast would take all of them through the driver

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1):
            r = b.to_pylist()[0]
            ids, own, q_ids, q_own = (np.frombuffer(r[c], np.int64) for c in ("ids", "own", "q_ids", "q_own"))
            x = matrix(r["m"], r["width"], len(ids)).T
            highest = float(np.abs(x).max(initial=0))
            x = np.ascontiguousarray(x, np.int32 if highest < 2**31 else np.int64)
            out: list[list[np.ndarray]] = [[], [], [], []]
            here = set(own.tolist())
            for qid, mine, q in zip(q_ids, q_own, matrix(r["q_m"], r["q_width"], len(q_ids)), strict=True):
                scores = accumulate(q, x, highest)
                if int(mine) in here:
                    others = np.flatnonzero(own != mine)
                    at = others[best(ids[others], scores[others], k)]
                else:
                    at = best(ids, scores, k)
                for o, v in zip(out, (np.full(len(at), qid), np.full(len(at), mine), ids[at], scores[at]), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], ["query_id", "own", "vec_id", "score"])

    found = pairs.select("ids", "own", "m", "width", "q_ids", "q_own", "q_m", "q_width").mapInArrow(search, "query_id long, own long, vec_id long, score long")
    # the rank limit is applied before the shuffle too, so k rows a query and task are dealt out
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id"))
    out = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk")
    for x in (blocks, asked, queries):
        dropped(x)
    return out


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH e AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), u AS (
  SELECT own, vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS term FROM e
), s AS (
  SELECT q.own AS q_own, q.vec_id AS query_id, c.own AS c_own, c.vec_id AS vec_id, sum(q.w * c.w)::BIGINT AS score
  FROM u q JOIN u c ON q.term = c.term AND q.own <> c.own
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2, 3, 4
), r AS (
  SELECT *, row_number() OVER (PARTITION BY q_own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
