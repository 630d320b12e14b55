"""Near-duplicate groups by HyperMinHash.

A text's set of 5-word shingles (64-bit values mixed from XXH3 values of the words) is sketched in ``BUCKETS`` registers: of the smallest value
in each bucket, the count of leading zeros and ``MANTISSA`` bits after them. Equal sets are one text from here
on. For banding, empty buckets borrow the register of a bucket in use, by a sequence of their own, so that two
registers agree with the probability of the similarity whatever the size of the sets. ``ROWS`` registers make a
band, and texts that share a band are candidates; at a similarity of 0.85, all 64 bands miss a pair with a
probability of about 1e-9; at 0.3 and less, a pair is a candidate with one of 0.004 and less.

Texts that share bands by chance would chain into clusters that grow with the square of the input and more, so candidates are judged by their
registers before they form clusters: each text is compared with the smallest id of each of its bands, and where one is
not near that, all texts of the band are compared among themselves, in tiles of bounded size. *Near* is an estimate
within six standard deviations of the threshold or above, so no link is lost. Near texts form clusters, whose texts meet
in tiles of bounded size. In a tile, the Jaccard similarity is first estimated from the registers, corrected
for registers that agree by accident, and pairs within six standard deviations of the threshold or above are
verified on the full sets. A pair is skipped only where its texts are linked through others already, so the
groups are those of all links.

Band values are dealt out as packed arrays; a
cluster too large for one tile is split into blocks, and every two blocks meet in a tile of their own.

Defined results: null texts and texts without words have no shingles and are linked with nothing; shorter
texts are one shingle, their whole word sequence; ids are distinct nodes, so rows that repeat an id are
one node with the links of all its rows; rows with a null id stand alone (component null, kept); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import arrow_batches, dropped, released, shuffle_partitions, stored, swept, table
from llm.components import components

WORDS, PERCENT = 5, 85
BUCKETS, MANTISSA, ROWS = 512, 10, 8
BANDS = BUCKETS // ROWS
#: Where an empty bucket borrows from: the first bucket in use of its own fixed sequence.
PROBES = np.random.Generator(np.random.PCG64(5)).integers(0, BUCKETS, (BUCKETS, 48))
#: Chance that the registers of two different smallest values agree: equal zero counts (1/3) and mantissas.
ACCIDENT = 2.0**-MANTISSA / 3
TILE_TEXTS, TILE_SHINGLES = 2048, 4_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64
FACTORS = np.random.Generator(np.random.PCG64(4)).integers(0, 2**63, (WORDS + 1, WORDS), dtype=np.uint64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle values of one text."""
    found = (text or b"").translate(LOWER).split()  # at 0x20 and 0x09 to 0x0D
    if not found:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * FACTORS[k, i]
    return np.unique(mixed(out))


def sketch(values: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 for an empty bucket, else (leading zeros + 1) << MANTISSA | mantissa."""
    out = np.zeros(BUCKETS, np.uint16)
    if len(values):
        bits = BUCKETS.bit_length() - 1
        bucket = (values >> U64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        rest = values[first] << U64(bits)
        zeros = np.minimum(62, 63 - np.floor(np.log2(np.maximum(rest, U64(1)).astype(np.float64))).astype(np.int64)).clip(0)
        mantissa = (rest << (zeros + 1).astype(np.uint64)) >> U64(64 - MANTISSA)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """A value for each band; none for an empty set."""
    used = registers != 0
    if not used.any():
        return np.zeros(0, np.uint64)
    if not used.all():
        empty = np.flatnonzero(~used)
        tried = used[PROBES[empty]]
        found = tried.any(axis=1)
        source = PROBES[empty, tried.argmax(axis=1)]
        at = np.flatnonzero(used)  # beyond the sequence: the next bucket in use
        source[~found] = at[np.searchsorted(at, empty[~found]) % len(at)]
        registers = registers.copy()
        registers[empty] = registers[source]
    rows = registers[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        out = mixed(out + rows[:, i])
    return out


def estimates(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of one sketch with many, and the registers they rest on."""
    used = np.maximum(1, ((many != 0) | (one != 0)).sum(axis=1))
    agree = ((many == one) & (one != 0)).sum(axis=1)
    return (agree / used - ACCIDENT) / (1 - ACCIDENT), used


def near(one: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sketches may be linked with one: estimates within six standard deviations of the threshold, or above."""
    guess, used = estimates(one, many)
    return guess >= percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / used)


def near_forest(ids: list[int], registers: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what all near pairs among the sketches connect."""
    out, group, done = [], np.arange(len(ids)), np.zeros(len(ids), bool)
    x = 0
    while True:
        done[x] = True
        found = np.flatnonzero(near(registers[x], registers, percent) & (group != group[x]))
        for g in np.unique(group[found]):
            y = int(found[group[found] == g][0])
            out.append((ids[x], ids[y]))
            group[group == g] = group[x]
        left = np.flatnonzero(~done & (group != np.bincount(group).argmax()))
        if not len(left):
            return out
        x = int(left[0])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def forest(ids: list[int], sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets connect."""
    first: dict[bytes, int] = {}
    out, keep = [], []
    for i, s in enumerate(sets):
        j = first.setdefault(s.tobytes(), i)
        if i == j:
            keep.append(i)
        elif ids[i] != ids[j]:
            out.append((ids[i], ids[j]))
    sets, ids = [sets[i] for i in keep], [ids[i] for i in keep]
    m = len(sets)
    group = np.arange(m)
    registers = np.stack([sketch(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    for name in {i for i in ids if ids.count(i) > 1} if len(set(ids)) < m else ():  # rows of one id are one node
        same = [k for k in range(m) if ids[k] == name]
        group[same] = same[0]
    done = np.zeros(m, bool)
    some = np.unique(np.linspace(0, m - 1, min(m, 16)).astype(int))
    x = int(max(some, key=lambda k: (estimates(registers[k], registers)[0] >= percent / 100).sum())) if m > 2 else 0
    while True:
        done[x] = True
        close = near(registers[x], registers, percent)
        fits = 100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x])
        for y in np.flatnonzero(close & fits & (group != group[x])):
            if group[y] != group[x] and linked(sets[x], sets[y], percent):
                out.append((ids[x], ids[y]))
                group[group == group[y]] = group[x]
        main = np.bincount(group).argmax()
        left = np.flatnonzero(~done & (group != main))
        if not len(left):
            return out
        x = int(left[0])


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, values = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t)
                k = np.arange(1, len(s) + 1, dtype=np.uint64)
                sizes.append(len(s))
                names.append(np.array([s.sum(), mixed(s + k).sum()], np.uint64).tobytes() if len(s) else None)
                values.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "n_shingles", "set_name", "registers"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(lambda batches: released(made(batches)), "doc_id long, n_shingles long, set_name binary, registers binary")


def candidates(reps: DataFrame) -> DataFrame:
    """The texts that share a band, as sorted arrays of distinct ids (members), each array once."""
    n = shuffle_partitions(reps.sparkSession)
    ranges = 4 * n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
            k, i = np.concatenate(keys), np.concatenate(ids)
            order = np.argsort(k)
            k, i = k[order], i[order]
            at = np.concatenate([[0], np.searchsorted(k, np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)), [len(k)]])
            rows = [(r, k[at[r] : at[r + 1]].tobytes(), i[at[r] : at[r + 1]].tobytes()) for r in range(ranges) if at[r + 1] > at[r]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["r", "k", "i"])

        keys, ids, size = [], [], 0
        for b in batches:
            for rep, data in zip(b.column("rep").to_pylist(), b.column("registers").to_pylist(), strict=True):
                keys.append(bands(np.frombuffer(data, np.uint16)))
                ids.append(np.full(len(keys[-1]), rep, np.int64))
                size += len(keys[-1])
                if size > 1 << 21:
                    yield sent(keys, ids)
                    keys, ids, size = [], [], 0
        if size:
            yield sent(keys, ids)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(held: list[dict]) -> Iterator[pa.RecordBatch]:
            k, i = np.frombuffer(b"".join(x["k"] for x in held), np.uint64), np.frombuffer(b"".join(x["i"] for x in held), np.int64)
            order = np.lexsort((i, k))
            k, i = k[order], i[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])  # rows of one id may share a band
            k, i = k[new], i[new]
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
            found = list({i[at[j] : at[j + 1]].tobytes() for j in np.flatnonzero(np.diff(at) > 1)})
            for j in range(0, len(found), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(found[j : j + 1000], pa.binary())], ["members"])

        held: list[dict] = []
        for b in batches:
            for x in b.to_pylist():
                if held and held[0]["r"] != x["r"]:
                    yield from groups(held)
                    held = []
                held.append(x)
        if held:
            yield from groups(held)

    dealt = reps.select("rep", "registers").mapInArrow(lambda batches: released(deal(batches)), "r int, k binary, i binary").repartition(n, "r").sortWithinPartitions("r")
    return dealt.mapInArrow(lambda batches: released(meet(batches)), "members binary").distinct()


def judged(reps: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what all near pairs within the groups connect."""
    sketches = reps.select("rep", "registers")

    def ends(least: int, name: bool = False):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for m in b.column("members").to_pylist():
                    ids = np.frombuffer(m, np.int64)
                    for at in range(1, len(ids) if len(ids) >= least else 0, 100_000):
                        own = ids[at : at + 100_000]
                        columns = [pa.array(own), pa.array(np.full(len(own), ids[0]))]
                        if name:
                            columns += [pa.array([xxhash.xxh3_128_digest(m)] * len(own), pa.binary()), pa.array(np.full(len(own), len(ids)))]
                        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "cluster", "size"][: len(columns)])

        return each

    pairs = groups.mapInArrow(ends(2), "a long, b long").distinct()
    one = pairs.join(sketches.hint("merge").withColumnRenamed("rep", "a"), "a").withColumnRenamed("registers", "one")
    both = one.join(sketches.hint("merge").withColumnRenamed("rep", "b"), "b").select("a", "b", "one", "registers")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("one", "registers"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(near(one, two, percent), pa.bool_())], ["a", "b", "near"])

    told = stored(both.mapInArrow(lambda batches: released(compare(batches)), "a long, b long, near boolean").groupBy("a", "b").agg(F.max("near").alias("near")), "judged")
    # a text that is not near the smallest id of a band may be near others of that band
    members = groups.mapInArrow(ends(3, True), "a long, b long, cluster binary, size long")
    far = members.join(told.filter("NOT near").hint("merge"), ["a", "b"]).select("cluster").distinct()
    inside = stored(members.join(far.hint("merge"), "cluster", "left_semi"), "bands")  # without its smallest id, which all were compared with; where that is near some, it links them
    blocks = F.ceil(F.col("size") / TILE_TEXTS).cast("int")
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    rows = inside.select("a", "cluster", blocks.alias("blocks")).join(sketches.hint("merge").withColumnRenamed("rep", "a"), "a").withColumn("own", own)
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("a").alias("rep"), "registers")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            found = near_forest([h[0] for h in held], np.frombuffer(b"".join(h[1] for h in held), np.uint16).reshape(-1, BUCKETS), percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        tile, held = None, []
        for b in batches:
            for x in b.to_pylist():
                if (at := (x["cluster"], x["i"], x["j"])) != tile:
                    if held:
                        yield links(held)
                    tile, held = at, []
                held.append((x["rep"], x["registers"]))
        if held:
            yield links(held)

    met = tiles.repartition(shuffle_partitions(reps.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda batches: released(check(batches)), "a long, b long")
    out = stored(told.filter("near").select("a", "b").unionByName(met).distinct(), "near")
    for x in (told, inside):
        dropped(x)
    return out


def verified(docs: DataFrame, clusters: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """Edges of the links within clusters (rep, cluster, n_shingles)."""
    n = shuffle_partitions(docs.sparkSession)
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE_TEXTS), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    members = clusters.join(sizes, "cluster").select("rep", "cluster", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own"))
    rows = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).cast("binary").alias("text")).join(members.hint("merge"), "rep")  # the same plan at every size
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = rows.select("cluster", "rep", "text", "own", other).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            found = forest(ids, sets, percent) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        tile, ids, sets = None, [], []
        for b in batches:
            for x in b.to_pylist():
                if (at := (x["cluster"], x["i"], x["j"])) != tile:
                    if ids:
                        yield links(ids, sets)
                    tile, ids, sets = at, [], []
                ids.append(x["rep"])
                sets.append(shingles(x["text"]))
        if ids:
            yield links(ids, sets)

    return tiles.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(lambda batches: released(check(batches)), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    with arrow_batches(spark):
        all_sets = stored(sketched(docs, doc_id, text), "sketches")
        named = all_sets.filter("set_name IS NOT NULL AND doc_id IS NOT NULL")
        reps = stored(named.groupBy("set_name").agg(F.min("doc_id").alias("rep"), F.first("registers").alias("registers"), F.max("n_shingles").alias("n_shingles")), "texts")
        swept(spark)
        groups = stored(candidates(reps), "groups")
        swept(spark)
        edges = judged(reps, groups, percent)
        swept(spark)
        grouped = components(edges, "a", "b")
        swept(spark)
        # every set of an id's rows joins the id's cluster; a cluster's label is a member too
        inside = grouped.select(F.col("node").alias("rep"), F.col("label").alias("cluster")).unionByName(grouped.select(F.col("label").alias("rep"), F.col("label").alias("cluster"))).distinct()
        weight = reps.groupBy("rep").agg(F.sum("n_shingles").alias("n_shingles"))
        clusters = stored(inside.join(weight, "rep").select("rep", "cluster", "n_shingles"), "clusters")
        links = stored(verified(docs, clusters, doc_id, text, percent), "links")
        swept(spark)
        # rows that repeat an id are one node: each of its sets' representatives is linked with it
        own = named.join(reps.select("set_name", "rep"), "set_name").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
        labels = components(links.unionByName(own), "a", "b")
        out = all_sets.select("doc_id", "n_shingles").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "doc_id"))
        out = stored(out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "neardup")
        for x in (all_sets, reps, groups, edges, clusters, links):
            dropped(x)
        swept(spark)
        return out


def op3_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
