"""Toxicity by compression distance with a toxic and an ordinary zstandard dictionary.

Text is read as its runs of letters, in small letters, one space between. A *window* is ``WINDOW`` such words in a
row; a new one begins every ``STEP`` words. Each window is compressed twice, once with the ordinary and once
with the toxic dictionary; the bytes that the toxic one saves are its distance. A document's distances, added up and divided by the
square root of the number of its windows, are its evidence: of windows without a sign, chance adds up no faster. The
evidence, in steps, has a probability that rises with it (isotonic regression), calibrated on training documents that took
no part in the dictionaries.

Both dictionaries come from ``train_dictionary``. A toxic document is ordinary prose but for a few words, so the
toxic text to train on is found by compression too:

1. The base dictionary is trained on ordinary documents. The toxic documents are split in two halves, a dictionary is trained on
   either, and every window of one half is compressed with the base, with and without the other half's
   dictionary. What saves bytes there recurs in toxic documents and is not in the base. Ordinary windows that save bytes
   too are hard cases: a dictionary trained on them joins the base, and the halves are measured once more.
2. The places where the saved bytes peak, with a word on either side, train the toxic dictionary.
3. Ordinary windows that it still shortens are hard cases: ``ROUNDS`` times, a dictionary trained on them joins
   the ordinary one.

The toxic compressor has the toxic dictionary in front of the whole ordinary one, so both code ordinary words in the
same bytes. The dictionaries are used as content without their entropy tables: with those, a letter costs half a byte, and
a word's few bytes drown in rounding. ``PAD`` equal bytes at a window's end make every block shrink, since
zstandard stores blocks that do not shrink as they are.

A window can only shorten by a string that the toxic dictionary has and the ordinary one has not. So where texts are scored, windows
without such a string of ``STRINGS`` bytes are not compressed; their distance is 0. (A longer string of which all
parts are in the ordinary dictionary goes unseen; on held-out documents 18 of 23,739 distances came from such.)

Learned from about ``SAMPLE`` toxic and 3 x ``SAMPLE`` ordinary labelled documents, chosen by a hash of the id, of each at
most ``READ`` words in passages of ``PASSAGE``, evenly over its length; of copies among them one counts. A third is kept for
calibration, on whole texts. The calibration weighs the two classes as they stand among all training
labels, so the same evidence gets the same probability at every size of the table.

Defined results: null and empty texts, and texts without letters, get the probability of no evidence; runs of over
``LONGEST`` letters are read as pieces of that length; equal texts get equal scores; without toxic labels every score is 0;
rows with a null label are no examples; of several labels of one document the largest holds; other columns pass
through, but for those named like an output, which the output replaces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from llm.common import bounded, hash_sample, held_out, parts_of, released, table

SAMPLE, READ, PASSAGE = 2500, 400, 40
LONGEST, WINDOW, STEP, PAD = 48, 4, 2, 24
#: Bytes of the dictionaries: of ordinary text, of half the toxic documents, of hard cases, toxic.
BASE, HALF, HARD, TOXIC = 1 << 18, 1 << 17, 1 << 14, 3 << 13
#: Bytes a window that a peak must save on average; bytes that make an ordinary window a hard case; rounds of them.
PEAK, TOO_NEAR, ROUNDS, DOUBT = 1.5, 2, 3, 0.02
#: Steps of evidence to a byte, and the last step.
STEPS, TOP, THRESHOLD = 8, 80, 0.3
LETTERS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
PARAMETERS = {"window_log": 20, "hash_log": 19, "chain_log": 19, "search_log": 6, "min_match": 6, "strategy": zs.STRATEGY_GREEDY, "target_length": 64, "write_content_size": False, "write_dict_id": False}
#: Windows and bytes of text that are handled at a time.
AT_ONCE, BYTES_AT_ONCE = 20_000, 1 << 19
#: Lengths of the strings that are looked for before a window is compressed.
STRINGS = (6, 7, 8, 9, 10)


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def passages(found: list[str], most: int | None = None) -> list[list[str]]:
    """The words in passages; where there are more than ``most`` words, passages evenly over them."""
    starts = range(0, len(found), PASSAGE)
    if most is not None and len(found) > most:
        n = max(1, most // PASSAGE)
        starts = [starts[i * len(starts) // n] for i in range(n)]
    return [found[i : i + PASSAGE] for i in starts]


class Windows:
    """The windows of some texts (lists of words): where each begins and ends in ``data``, and its text's number."""

    def __init__(self, texts: list[list[str]], step: int = STEP):
        encoded = [f" {' '.join(t)} ".encode("utf-8", "surrogatepass") for t in texts]
        self.data, self.texts = b"".join(encoded), len(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        blank = np.flatnonzero(self.bytes == 32)
        ends = np.cumsum([len(e) for e in encoded])
        own = np.searchsorted(ends, blank, side="right")
        word = np.flatnonzero((own[1:] == own[:-1]) & (np.diff(blank) > 1)) if len(blank) else np.zeros(0, np.int64)
        text = own[word]
        count = np.bincount(text, minlength=self.texts)
        first = np.cumsum(count) - count
        at = np.flatnonzero((np.arange(len(word)) - first[text]) % step == 0)
        last = np.minimum(at + WINDOW, (first + count)[text[at]]) - 1
        self.starts, self.lengths, self.text = blank[word[at]], blank[word[last] + 1] + 1 - blank[word[at]], text[at]
        self.word_ends = blank[word[at] + 1] + 1
        #: Windows that meet over the first words of each.
        self.over = np.minimum(np.arange(len(at)), -(-WINDOW // step) - 1) if len(at) else at
        self.over = np.minimum(self.over, np.arange(len(at)) - np.searchsorted(self.text, self.text))

    def cut(self, which: np.ndarray, before: int = 0, after: int = 0) -> list[bytes]:
        """The windows; or, with windows at every word, their first words with the words around them."""
        if not before and not after:
            return [self.data[a : a + n] for a, n in zip(self.starts[which].tolist(), self.lengths[which].tolist(), strict=True)]
        a, b = self.starts[np.maximum(0, which - before)], self.word_ends[np.minimum(len(self.starts) - 1, which + after)]
        return [self.data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]

    def saved(self, one, two, only: np.ndarray | None = None) -> np.ndarray:
        """Bytes that the second compressor saves over the first, per window (0 for windows left out)."""
        out = np.zeros(len(self.starts), np.int64)
        which = np.arange(len(out)) if only is None else np.flatnonzero(only)
        for k in range(0, len(which), AT_ONCE):
            some = which[k : k + AT_ONCE]
            inside = self.lengths[some]
            size = inside + PAD
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(begin, size)
            padded = np.where(place < np.repeat(inside, size), self.bytes[np.minimum(np.repeat(self.starts[some], size) + place, len(self.bytes) - 1)], 10).astype(np.uint8)
            segments = zs.BufferWithSegments(padded.tobytes(), np.stack([begin, size], axis=1).astype("<u8").tobytes())
            a, b = (np.fromiter(map(len, c.multi_compress_to_buffer(segments, threads=1)), np.int64, len(some)) for c in (one, two))
            out[some] = a - b
        return out

    def summed(self, saved: np.ndarray) -> np.ndarray:
        """Bytes saved by the windows that meet over the first words of each."""
        sums = np.concatenate([[0], np.cumsum(saved)])
        at = np.arange(len(saved))
        return sums[at + 1] - sums[at - self.over]


def codes(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``STRINGS``, the values of the strings of that length."""
    x = x.astype(np.uint64)
    c = np.zeros(len(x) + 1, np.uint64)
    for n in range(1, min(STRINGS[-1], len(x)) + 1):
        c = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
        if n in STRINGS:
            yield n, c ^ (c >> np.uint64(29))


def compressor(content: bytes):
    parameters = zs.ZstdCompressionParameters(**PARAMETERS)
    d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=parameters)
    return zs.ZstdCompressor(dict_data=d, compression_params=parameters)


def dictionary(size: int, samples: list[bytes], segment: int = 16) -> bytes:
    """Trained on the samples; too few to train on are a dictionary themselves."""
    samples = [samples[i] for i in np.random.Generator(np.random.PCG64(1)).permutation(len(samples))]
    try:
        return zs.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[:size]


class Distance:
    """Distances between the two dictionaries; ``chances`` by a text's features once it is calibrated."""

    def __init__(self, ordinary: bytes, toxic: bytes, chances: np.ndarray | None = None):
        self.ordinary, self.toxic, self.chances = ordinary, toxic, chances
        self.pair = self.only_toxic = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.chances

    def __setstate__(self, state):
        self.__init__(*state)

    def compressors(self) -> tuple:
        if self.pair is None:
            self.pair = compressor(self.ordinary or b"ordinary"), compressor(self.toxic + (self.ordinary or b"ordinary"))
        return self.pair

    def strings(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length, the strings of the toxic dictionary that the ordinary one has not (also those that run from one
        into the other): as a table of their values' last bits, and the values."""
        if self.only_toxic is None:
            self.only_toxic = {}
            known = dict(codes(np.frombuffer(self.ordinary, np.uint8)))
            for n, c in codes(np.frombuffer(self.toxic + self.ordinary[: STRINGS[-1]], np.uint8)):
                own, marks = np.setdiff1d(c, known.get(n, np.zeros(0, np.uint64))), np.zeros(1 << 20, bool)
                marks[own & np.uint64(0xFFFFF)] = True
                self.only_toxic[n] = marks, own
        return self.only_toxic

    def worth(self, w: Windows) -> np.ndarray:
        """Which windows have a string that only the toxic dictionary has."""
        out = np.zeros(len(w.starts), bool)
        ends = w.starts + w.lengths
        for n, c in codes(w.bytes):
            marks, own = self.strings().get(n, (None, None))
            if own is None or not len(own):
                continue
            at = np.flatnonzero(marks[c & np.uint64(0xFFFFF)])
            at = at[own[np.minimum(np.searchsorted(own, c[at]), len(own) - 1)] == c[at]]
            seen = np.zeros(len(c) + 1, np.int64)
            seen[at + 1] = 1
            np.cumsum(seen, out=seen)
            begin = np.minimum(w.starts, len(c))
            out |= seen[np.clip(ends - n + 1, begin, len(c))] > seen[begin]
        return out

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The step of each text's evidence."""
        out = np.zeros(len(texts), np.int64)
        done = 0
        while done < len(texts):
            end, size = done, 0
            while end < len(texts) and (end == done or size + len(texts[end] or "") <= BYTES_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            w = Windows([words(t) for t in texts[done:end]])
            total = np.bincount(w.text, weights=np.maximum(0, w.saved(*self.compressors(), self.worth(w))), minlength=end - done)
            out[done:end] = STEPS * total / np.sqrt(np.maximum(1, np.bincount(w.text, minlength=end - done)))
            done = end
        return np.minimum(out, TOP)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.chances is None:
            return np.zeros(len(texts))
        return self.chances[self.evidence(texts)]

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def calibrate(self, seen: np.ndarray, all_toxic: int, all_ordinary: int) -> Distance:
        """From the numbers of texts by label and step: the share of toxic ones, made to rise with the step by
        joining neighbours that fall; the classes weigh as they stand among all labels. Each step also counts as
        much as one text of that overall share."""
        share, total = all_toxic / (all_toxic + all_ordinary), seen.sum()
        seen = seen * (np.array([1 - share, share]) * total / np.maximum(1, seen.sum(axis=1)))[:, None]
        pools: list[tuple[float, float, int]] = []  # toxic, all, steps
        for toxic, both in zip((seen[1] + share / len(seen[1])).tolist(), (seen.sum(axis=0) + 1 / len(seen[1])).tolist(), strict=True):
            steps = 1
            while pools and pools[-1][0] * both >= toxic * pools[-1][1]:
                t, n, k = pools.pop()
                toxic, both, steps = toxic + t, both + n, steps + k
            pools.append((toxic, both, steps))
        self.chances = np.concatenate([np.full(k, (t + share) / (n + 1)) for t, n, k in pools])
        return self


def unlike(texts: list[list[str]]) -> list[int]:
    """The texts of which less than half the 3-word sequences stand in texts before: one of each group of copies.
    One sequence in four is looked at, by its hash; of texts with few, all."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        runs = {zlib.crc32(" ".join(t[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(t) - 2))}
        runs = {r for r in runs if len(runs) < 64 or r % 4 == 0}
        if len(runs & seen) * 2 < len(runs):
            out.append(i)
        seen |= runs
    return out


def cases(ordinary: Windows, found: np.ndarray, toxic: Windows, also: np.ndarray) -> np.ndarray:
    """The ordinary windows found, but for those of texts that look mislabelled: texts with a larger share of them than
    three in four toxic texts have, the ``DOUBT`` with the largest shares at most."""
    share = lambda w, which: np.bincount(w.text[which], minlength=w.texts) / np.maximum(1, np.bincount(w.text, minlength=w.texts))
    shares = share(ordinary, found)
    cut = max(np.quantile(share(toxic, also), 0.25), np.quantile(shares, 1 - DOUBT))
    return np.flatnonzero(found & (shares <= cut)[ordinary.text])


def trained(toxic: list[list[str]], ordinary: list[list[str]]) -> Distance:
    """Both dictionaries, from the words of texts of both classes; not calibrated yet."""
    if not toxic or not ordinary:
        return Distance(b"", b"")
    joined = lambda texts: [f" {' '.join(p)} ".encode("utf-8", "surrogatepass") for t in texts for p in passages(t)]
    base = dictionary(BASE, joined(ordinary), 64)
    halves = [dictionary(HALF, joined(toxic[1 - h :: 2]), 64) for h in (0, 1)]
    at_toxic, at_ordinary = Windows(toxic, 1), Windows(ordinary, 1)
    least = PEAK * WINDOW

    def measured(w: Windows) -> np.ndarray:
        gain, one = np.zeros(len(w.starts), np.int64), compressor(base)
        for h in (0, 1):
            gain += w.saved(one, compressor(halves[h] + base), w.text % 2 == h)
        return w.summed(gain)

    hard = cases(at_ordinary, measured(at_ordinary) >= least, at_toxic, measured(at_toxic) >= least)
    base = dictionary(4 * HARD, at_ordinary.cut(hard, 1, 1)) + base
    sums = np.concatenate([[0], measured(at_toxic), [0]])
    peaks = np.flatnonzero((sums[1:-1] >= least) & (sums[1:-1] >= sums[:-2]) & (sums[1:-1] >= sums[2:]))
    telling = dictionary(TOXIC, at_toxic.cut(peaks, 1, 1))
    near, at_ordinary, at_toxic = base, Windows(ordinary), Windows(toxic)
    for _ in range(ROUNDS):
        pair = compressor(near), compressor(telling + near)
        hard = cases(at_ordinary, at_ordinary.saved(*pair) >= TOO_NEAR, at_toxic, at_toxic.saved(*pair) >= TOO_NEAR)
        if not len(hard):
            break
        near = dictionary(HARD, at_ordinary.cut(hard)) + near
    return Distance(near, telling)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Distance:
    """From the labelled documents that are not held out. Passages of the sample meet in one task, which trains the
    dictionaries; these and the ids set aside reach the driver. The calibration counts its texts' features where they are."""
    bounded(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    all_toxic, all_ordinary = known.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not all_toxic or not all_ordinary:
        return Distance(b"", b"")
    toxic = hash_sample(known.filter("toxic = 1"), "doc_id", "toxic", sample)
    plain = hash_sample(known.filter("toxic = 0"), "doc_id", "toxic", 3 * sample)
    chosen = F.broadcast(toxic.unionByName(plain))  # about 4 x sample rows of two integers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            texts = [" ".join(w for p in passages(words(t), READ) for w in p) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(texts, pa.string())], ["doc_id", "toxic", "text"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, same = ([], []), ([], []), {}
        for b in parts_of(batches, 1000):
            for i, label, t in zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids[label].append(i)
                texts[label].append([same.setdefault(w, w) for w in t.split(" ")] if t else [])
        kept = []
        for label in (0, 1):
            apart = unlike(texts[label])
            cut = -(-len(apart) * 2 // 3)
            kept += [ids[label][i] for i in apart[cut:] or apart]
            texts[label][:] = [texts[label][i] for i in apart[:cut]]
        made = trained(texts[1], texts[0])
        yield pa.RecordBatch.from_arrays([pa.array([made.ordinary], pa.binary()), pa.array([made.toxic], pa.binary()), pa.array([kept], pa.list_(kind))], ["ordinary", "toxic", "kept"])

    order = F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")
    kinds = dict(rows.dtypes)
    kind = to_arrow_type(rows.schema["doc_id"].dataType)
    got = rows.mapInArrow(read, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, text string").repartition(1).sortWithinPartitions(*order)
    made = got.mapInArrow(lambda batches: released(train(batches)), f"ordinary binary, toxic binary, kept array<{kinds['doc_id']}>").collect()
    model = Distance(bytes(made[0].ordinary), bytes(made[0].toxic)) if made else Distance(b"", b"")
    kept = made[0].kept if made else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(model.evidence(b.column("text").to_pylist()), pa.int32())], ["label", "step"])

    aside = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], f"doc_id {kinds['doc_id']}"))  # a third of the sample
    checked = rows.join(aside, "doc_id").select("toxic", "text").mapInArrow(count, "label int, step int")
    seen = np.zeros((2, TOP + 1))
    for r in checked.groupBy("label", "step").count().collect():
        seen[r.label, r.step] = r["count"]
    return model.calibrate(seen, all_toxic, all_ordinary)


def score_toxicity(docs: DataFrame, model: Distance, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the rows, whose other columns pass through."""
    bounded(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    columns = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # under 400 KB

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches, 1000):
            scores = shared.value.scores(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(scores >= threshold).cast(pa.int32())], [*columns, "score", "predicted"])

    return docs.mapInArrow(lambda batches: released(scored(batches)), schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
