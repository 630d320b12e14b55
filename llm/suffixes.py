"""Removal of repeated passages by a difference cover of the suffixes, cut at ``length`` bytes.

This departs from the textbook algorithm: names are values of bytes, not ranks, since only the equality of prefixes of
``length`` bytes matters here and no order among them; so names that occur once are dropped instead of recursed on, blocks are widened
once, and what is left is merged by value. Matches rest on names, not on bytes side by side.

Two equal passages of ``length`` bytes share, whatever their places, an offset at which both have a sampled
position of a difference cover modulo v. So:

1. *Sampled blocks.* Each sampled position's block of ``length - v + 1`` bytes gets a name (a 64-bit value of its
   bytes); names are sorted per range, and names that occur once are dropped with their positions.
2. *Recursion on the names that are left.* Blocks are widened to ``length + v - 1`` bytes around the sample. Equal
   wide names prove all v suffixes that start in reach to be repeated; one leader of each group answers for them.
3. *Merge of the remaining suffixes.* The suffixes in reach of a repeated block that are not proven yet, and the
   leaders' suffixes, are sorted by their first ``length`` bytes (96-bit names), and adjacent prefixes compared.

Texts are packed once into chunks, a table bucketed by chunk in the warehouse; each round sends a chunk's distinct
names, sorted, to the tasks of their ranges and gets one bit (round 2: two) for each back. A chunk sends a name
once, so a passage that a third of all texts hold costs one name for each chunk and not one for each text; sampled
positions start at an offset of each document's own, so copies do not sample alike. Names are compared by value: 64
bits where a wrong match only costs work, 96 bits where it decides.

Defined results: null text is the empty text; texts shorter than ``length`` are kept whole; matches never cross
texts; equal rows are texts of their own, so both lose what they share; an empty table gives no rows; other columns
pass through, but for those named like an output, which the output replaces; memory follows the chunk (``CHUNK`` bytes, or one longer text).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import arrow_batches, dropped, parts_of, released, shuffle_partitions, stored, swept, table

#: Perfect difference sets: every residue modulo the key is a difference of two members.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
CHUNK = 2 << 20
#: Names are dealt out in so many ranges that one answers for the names of about this much text.
RANGE = 8 << 20
#: Round 3 has the most names; it deals them out in so many passes, each over a part of the ranges.
PASSES = 3
U64 = np.uint64


class Hasher:
    """Values of byte ranges from prefix sums of a polynomial over random byte values, modulo 2**64."""

    def __init__(self, seed: int):
        g = np.random.Generator(np.random.PCG64(seed))
        self.bytes = g.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(g.integers(0, 2**61)) * 8 + 5
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            for name, b in (("powers", self.base), ("inverses", pow(self.base, -1, 2**64))):
                steps = np.full(n + 1, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[:n], out=out[1:])
        return out

    def names(self, prefix: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        x = (prefix[starts + length] - prefix[starts]) * self.inverses[starts]
        x ^= x >> U64(32)
        x *= U64(0x9E3779B97F4A7C15)
        return x ^ (x >> U64(29))


FIRST, SECOND = Hasher(1), Hasher(2)


def sorted_groups(high: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal names are adjacent, and where each group begins in it."""
    order = np.argsort(high)
    new = np.ones(len(high), bool)
    h = high[order]
    new[1:] = h[1:] != h[:-1]
    if low is not None and len(high):
        differs = low[order][1:] != low[order][:-1]
        if (differs & ~new[1:]).any():  # equal 64 bits of different names
            order = np.lexsort((low, high))
            h, o = high[order], low[order]
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        else:
            new[1:] |= differs
    return order, new


class Names:
    """The distinct names of a chunk in order, and where each position's is."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None):
        order, new = sorted_groups(high, low)
        # the smallest place of each group, whatever order equal names come in on a machine
        self.first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        self.high, self.low = high[self.first], None if low is None else low[self.first]
        self.of = np.empty(len(high), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.many = np.bincount(self.of, minlength=len(self.first)) > 1

    def ranges(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranges (of 2**bits) that have names, and where each begins, and the end."""
        r = (self.high >> U64(64 - bits)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        return r[begins], np.append(begins, len(r))

    def slices(self, bits: int, passes: int, which: int) -> Iterator[tuple[int, bytes, bytes | None]]:
        """The names of the ranges of a pass: those whose number leaves ``which`` modulo ``passes``."""
        found, at = self.ranges(bits)
        for r, a, b in zip(found.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            if r % passes == which:
                yield r, self.high[a:b].tobytes(), None if self.low is None else self.low[a:b].tobytes()

    def flags(self, got: list | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(found in another chunk, leads its group) for each name."""
        out = np.zeros((2, len(self.high)), bool)
        found, at = self.ranges(bits)
        for x in got or []:
            k = int(np.searchsorted(found, x["r"]))
            a, b = at[k], at[k + 1]
            answer = np.unpackbits(np.frombuffer(x["bits"], np.uint8))
            out[:, a:b] = answer[: 2 * (b - a)].reshape(2, -1)
        return out[0], out[1]


class Chunk:
    def __init__(self, blob: bytes, lengths: list[int], offsets: list[int], length: int, cover: int):
        self.data = np.frombuffer(blob, np.uint8)
        self.n, self.length, self.v = len(self.data), length, cover
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.starts = self.ends - np.array(lengths, np.int64)
        self.block = length - cover + 1
        self.one, self.two = FIRST.prefix(self.data), None
        longest = max(lengths, default=0) + cover
        tile = np.zeros(longest + cover, bool)
        for d in COVERS[cover]:
            tile[d::cover] = True
        sampled = np.zeros(self.n, bool)
        for a, b, o in zip(self.starts, self.ends, offsets, strict=True):
            if b - a >= length:
                sampled[a : b - self.block + 1] = tile[o : o + b - self.block + 1 - a]
        self.samples = np.flatnonzero(sampled)
        self.names1 = Names(FIRST.names(self.one, self.samples, self.block))

    def wide(self, starts: np.ndarray, length: int) -> Names:
        if self.two is None:
            self.two = SECOND.prefix(self.data)
        return Names(FIRST.names(self.one, starts, length), (SECOND.names(self.two, starts, length) >> U64(32)).astype(np.uint32))

    def reach(self, samples: np.ndarray) -> np.ndarray:
        """Which positions start within v - 1 bytes before one of the samples (or at it)."""
        edge = np.zeros(self.n + 1, np.int32)
        np.add.at(edge, np.maximum(0, samples - (self.v - 1)), 1)
        np.add.at(edge, samples + 1, -1)
        return np.cumsum(edge[:-1]) > 0

    def round2(self, got1, bits: int) -> Names:
        found, _ = self.names1.flags(got1, bits)
        self.repeated = self.samples[(found | self.names1.many)[self.names1.of]]
        doc = np.searchsorted(self.ends, self.repeated, side="right")
        fits = (self.repeated - (self.v - 1) >= self.starts[doc]) & (self.repeated + self.length <= self.ends[doc])
        self.centres = self.repeated[fits]
        self.names2 = self.wide(self.centres - (self.v - 1), self.length + self.v - 1)
        return self.names2

    def round3(self, got2, bits: int) -> Names:
        found, leads = self.names2.flags(got2, bits)
        self.proven = self.reach(self.centres[(found | self.names2.many)[self.names2.of]])
        leaders = self.reach(self.centres[self.names2.first[leads | (self.names2.many & ~found)]])
        open_ = self.reach(self.repeated)
        for a, b in zip(self.starts, self.ends, strict=True):  # a reach stays in its text, and suffixes are long enough
            open_[max(a, b - self.length + 1) : b] = False
        # a reach that runs over a text's start marks the end of the text before, which is cleared too
        self.open = open_ & ~self.proven
        self.asked = np.flatnonzero(self.open | leaders)
        self.names3 = self.wide(self.asked, self.length)
        return self.names3

    def removed(self, got3, bits: int) -> np.ndarray:
        """Which bytes a repeated string covers."""
        found, _ = self.names3.flags(got3, bits)
        repeated = self.proven
        repeated[self.asked[(found | self.names3.many)[self.names3.of]]] = True
        edge = np.zeros(self.n + 1, np.int32)
        at = np.flatnonzero(repeated)
        edge[at] += 1
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def chunk_of(row: dict, length: int, cover: int) -> Chunk:
    return Chunk(row["blob"], row["lengths"], row["offsets"], length, cover)


def at_round(row: dict, length: int, cover: int, bits: int, which: int) -> tuple[Chunk, Names]:
    c = chunk_of(row, length, cover)
    names = c.names1
    if which > 1:
        names = c.round2(row["got1"], bits)
    if which > 2:
        names = c.round3(row["got2"], bits)
    return c, names


CHUNKS = "chunk long, lengths array<int>, offsets array<int>, rest binary, blob binary"


def packed(docs: DataFrame, text: str, cover: int, most: int) -> DataFrame:
    others = [c for c in docs.columns if c != text]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            data = [d or b"" for d in t.column(0).to_pylist()]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.drop_columns([t.column_names[0]]).schema) as w:
                w.write_table(t.drop_columns([t.column_names[0]]))
            offsets = [int.from_bytes(hashlib.blake2b(b"%d.%d.%d" % (task, made, i), digest_size=4).digest(), "big") % cover for i in range(len(data))]
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + made], pa.int64()), pa.array([[len(d) for d in data]], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int32())), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b"".join(data)], pa.binary())],
                ["chunk", "lengths", "offsets", "rest", "blob"],
            )

        for b in batches:
            begin = 0
            lengths = np.diff(np.frombuffer(b.column(0).buffers()[1], np.int32)[b.column(0).offset : b.column(0).offset + b.num_rows + 1])
            for i in range(b.num_rows):
                size += int(lengths[i])
                if size >= most or i == b.num_rows - 1:
                    held.append(b.slice(begin, i + 1 - begin))
                    begin = i + 1
                if size >= most:
                    yield chunk()
                    held, size, made = [], 0, made + 1
        if held:
            yield chunk()

    return docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("__text"), *(F.col(f"`{c}`") for c in others)).mapInArrow(lambda batches: released(pack(batches)), CHUNKS)


def answered(asked: DataFrame, wide: bool) -> DataFrame:
    """Per chunk, the flags of its names, range by range."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def answer() -> pa.RecordBatch:
            sizes = [len(x["high"]) // 8 for x in held]
            high = np.frombuffer(b"".join(x["high"] for x in held), np.uint64)
            low = np.frombuffer(b"".join(x["low"] for x in held), np.uint32) if wide else None
            order, new = sorted_groups(high, low)
            last = np.append(new[1:], True)
            shared, leads = np.empty(len(high), bool), np.empty(len(high), bool)
            shared[order], leads[order] = ~(new & last), new & ~last
            chunks, bits, at = [], [], 0
            for x, size in zip(held, sizes, strict=True):
                if shared[at : at + size].any():
                    chunks.append(x["chunk"])
                    bits.append(np.packbits(np.concatenate([shared[at : at + size], leads[at : at + size]])).tobytes())
                at += size
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([held[0]["r"]] * len(chunks), pa.int32()), pa.array(bits, pa.binary())], ["chunk", "r", "bits"])

        for b in batches:
            for x in b.to_pylist():
                if held and held[0]["r"] != x["r"]:
                    yield answer()
                    held = []
                held.append(x)
        if held:
            yield answer()

    dealt = asked.repartition(shuffle_partitions(asked.sparkSession), "r").sortWithinPartitions("r")
    return dealt.mapInArrow(compare, "chunk long, r int, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("r", "bits")).alias("got"))


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", chunk: int = CHUNK, as_text: bool = False) -> DataFrame:
    """The other columns of ``docs`` and kept (bytes; or text, without the characters a cut splits), n_bytes, n_removed, n_spans, from the shared folder."""
    spark = docs.sparkSession
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    cover = max((v for v in COVERS if v <= max(7, length // 2)), default=7)
    if length < cover:
        raise ValueError("length must be at least 7")
    n = shuffle_partitions(spark)
    name = f"llm_chunks_{uuid.uuid4().hex}"
    others = [c for c in docs.columns if c != text]
    answers: list[DataFrame] = []
    try:
        with arrow_batches(spark):
            packed(docs, text, cover, chunk).write.option("compression", "zstd").bucketBy(n, "chunk").format("parquet").saveAsTable(name)
        rows = spark.table(name)
        size = rows.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        bits = max(4 * n, size // RANGE, 2).bit_length()
        with arrow_batches(spark, 1000, 4 << 20):  # a chunk or two, or many names of a range
            for which, passes, part in [(1, 1, 0), (2, 1, 0), *((3, PASSES, k) for k in range(PASSES))]:

                def ask(batches: Iterator[pa.RecordBatch], which=which, passes=passes, part=part) -> Iterator[pa.RecordBatch]:
                    for b in parts_of(batches, 1):
                        row = b.to_pylist()[0]
                        found = list(at_round(row, length, cover, bits, which)[1].slices(bits, passes, part))
                        columns = [[x[i] for x in found] for i in range(3)]
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["r", "chunk", "high", "low"])

                asked = rows.drop("rest").mapInArrow(ask, "r int, chunk long, high binary, low binary")
                answers.append(stored(answered(asked, which > 1).withColumnRenamed("got", f"got{which}"), f"answers{which}"))
                del asked
                swept(spark)
                if which < 3:
                    rows = rows.join(answers[-1], "chunk", "left")
            last = reduce(DataFrame.unionByName, answers[2:])
            rows = rows.join(last.groupBy("chunk").agg(F.flatten(F.collect_list("got3")).alias("got3")), "chunk", "left")

            def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in parts_of(batches, 1):
                    row = b.to_pylist()[0]
                    c, _ = at_round(row, length, cover, bits, 3)
                    gone = c.removed(row["got3"], bits)
                    rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
                    begins = gone.copy()
                    begins[1:] &= ~gone[:-1]
                    kept, removed, spans = [], [], []
                    for a, e in zip(c.starts, c.ends, strict=True):
                        part = gone[a:e]
                        kept.append(c.data[a:e][~part].tobytes())
                        removed.append(int(part.sum()))
                        # a run that started in the text before is a run of this text too
                        spans.append(int(begins[a:e].sum()) + int(a > 0 and e > a and bool(part[0]) and not begins[a]))
                    columns = [rest.column(i).combine_chunks() if rest.num_rows else rest.column(i) for i in range(rest.num_columns)]
                    arrays = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array((c.ends - c.starts), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], [*others, "kept", "n_bytes", "n_removed", "n_spans"])

            kinds = dict(docs.dtypes)
            schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + (", " if others else "") + ("kept string" if as_text else "kept binary") + ", n_bytes long, n_removed long, n_spans long"
            return stored(rows.mapInArrow(lambda batches: released(finish(batches)), schema), "kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for a in answers:
            dropped(a)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
