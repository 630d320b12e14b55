"""Language ID by bit-sliced Bloom filters of n-grams.

One table of bit masks holds a Bloom filter per language: slot s keeps, in bit l, whether language l's
filter has s set. And-ing the slots of an n-gram gives the mask of all languages that contain it.
For a text, the languages' hit counts are corrected for their filters' false-positive rates
(hits - n * rate) / (1 - rate); the largest decides and its share of all is the score.

The filters are learned from about ``SAMPLE`` documents of each language, chosen by a hash of the
id, and at most ``READ`` characters of each, in ``PASSAGES`` passages evenly over it. A language contains the n-grams seen in its documents, but for those
whose frequency there is under ``OWN`` of their highest in any language (documents quote other languages).

A score says which language leads, not that the text is in any: a share of a few stray hits is as high.
``recognised`` tells that by the corrected hits of the leading language per n-gram with a letter, which
must reach ``LEAST`` of what all but ``ODD`` of its own training documents reach. That level comes from
filters of every other training document, read on the rest, so that it holds for texts not learned from.

Defined results: null texts and texts without a letter (Unicode's categories L) are ``und`` with score 0; ties go to the
alphabetically first language; with no labelled rows everything is ``und``; text that hits no filter
gets the first language with score 0; texts without an n-gram that has a letter, and all texts where nothing
was learned, are not recognised; repeated rows get equal values; other columns pass
through, but for those named like an output (``recognised`` only where it is asked for), which the output replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import bounded, hash_sample, held_out, parts_of, table

GRAM, SLOTS, HASHES, OWN, SAMPLE = 4, 1 << 18, 2, 0.05, 400
#: Characters read of a training document at most, in so many passages.
READ, PASSAGES = 20_000, 20
LEAST, ODD = 0.5, 0.01
BLANKS = int.from_bytes(b" " * GRAM, "big")
LETTER = regex.compile(r"\p{L}")
#: ASCII capitals to small letters and everything else that is no letter to one blank byte.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
UND = "und"


def grams(data: np.ndarray) -> np.ndarray:
    """A 32-bit code of the n-gram at each byte."""
    x = FOLD[data].astype(np.uint32)
    n = len(x) - GRAM + 1
    code = np.zeros(max(0, n), np.uint32)
    for i in range(GRAM):
        code = code * np.uint32(256) + x[i : i + n] if n > 0 else code
    return code


def slots(codes: np.ndarray, which: int) -> np.ndarray:
    x = codes * np.uint32((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[which])
    return (x ^ (x >> np.uint32(15))) & np.uint32(SLOTS - 1)


class Filters:
    def __init__(self, languages: list[str], table: np.ndarray, rates: np.ndarray):
        self.languages, self.table, self.rates = languages, table, rates
        self.levels: np.ndarray | None = None

    @classmethod
    def learned(cls, texts: dict[str, list[str]]) -> Filters:
        languages = sorted(texts)
        out = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        rates = np.zeros(len(languages))
        shares = {}
        for name in languages:
            found, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *(grams(np.frombuffer(t.encode(), np.uint8)) for t in texts[name])]), return_counts=True)
            shares[name] = found, counts / max(1, counts.sum())
        known, place = np.unique(np.concatenate([np.zeros(0, np.uint32), *(f for f, _ in shares.values())]), return_inverse=True)
        highest = np.zeros(len(known))
        np.maximum.at(highest, place, np.concatenate([np.zeros(0), *(s for _, s in shares.values())]))
        for k, name in enumerate(languages):
            found, share = shares[name]
            own = found[share >= OWN * highest[np.searchsorted(known, found)]]
            for h in range(HASHES):
                out[k // 64, slots(own, h)] |= np.uint64(1 << (k % 64))
            rates[k] = (((out[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** HASHES
        return cls(languages, out, rates)

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """The set of languages that contain each n-gram (bits of languages 64 * word and on)."""
        out = self.table[word][slots(codes, 0)]
        for h in range(1, HASHES):
            out &= self.table[word][slots(codes, h)]
        return out

    def hits(self, texts: list[str | None], letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits of each text in each language, and its n-grams; with letters, of those that have one."""
        data = [(t or "").encode() for t in texts]
        lengths = np.array([len(d) for d in data], np.int64)
        counts = np.maximum(0, lengths - GRAM + 1)
        codes = grams(np.frombuffer(b"".join(data), np.uint8))
        begins = np.minimum(np.cumsum(lengths) - lengths, len(codes))
        ends = np.minimum(begins + counts, len(codes))
        taken = codes != BLANKS if letters else np.ones(len(codes), bool)

        def within(marks: np.ndarray) -> np.ndarray:
            ones = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            return ones[ends] - ones[begins]

        found = np.zeros((len(texts), len(self.languages)))
        if letters:
            counts = within(taken)
        for word in range(len(self.table)):
            masks = self.masks(codes, word)
            for k in range(64 * word, min(len(self.languages), 64 * word + 64)):
                found[:, k] = within((masks >> np.uint64(k % 64)).astype(np.uint8) & 1 & taken)
        return np.maximum(0, (found - counts[:, None] * self.rates) / np.maximum(1e-9, 1 - self.rates)), counts

    def recognised(self, texts: list[str | None]) -> list[bool]:
        if not self.languages or self.levels is None:
            return [False] * len(texts)
        right, counts = self.hits(texts, letters=True)
        lead = right.argmax(1)
        return ((counts > 0) & (right[np.arange(len(texts)), lead] >= self.levels[lead] * counts)).tolist()

    def calibrate(self, texts: dict[str, list[str]]) -> Filters:
        """Sets each language's level from the texts it is learned from."""
        half = Filters.learned({name: own[::2] for name, own in texts.items()})
        self.levels = np.zeros(len(self.languages))
        for k, name in enumerate(self.languages):
            right, counts = half.hits(texts[name][1::2] or texts[name], letters=True)
            shares = right[counts > 0, k] / counts[counts > 0]
            self.levels[k] = LEAST * np.quantile(shares, ODD) if len(shares) else 1.0
        return self

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        right, _ = self.hits(texts)
        names, scores = [], []
        for t, r in zip(texts, right, strict=True):
            if t is None or not self.languages or not LETTER.search(t):
                names.append(UND)
                scores.append(0.0)
            else:
                k = int(r.argmax())
                names.append(self.languages[k])
                scores.append(float(r[k] / r.sum()) if r.sum() > 0 else 0.0)
        return names, scores


def evenly(length: Column, size: int) -> Column:
    """Where passages of ``size`` characters begin that lie evenly over a text of this length (from 1); in 64 bits, as 19 lengths
    pass 32 bits from 113 million characters on, which is an error in Spark."""
    return F.transform(F.sequence(F.lit(0), F.lit(PASSAGES - 1)), lambda i: (i.cast("long") * (length - size) / (PASSAGES - 1)).cast("int") + 1)


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, levels: bool = False) -> Filters:
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    size = READ // PASSAGES
    parts = F.transform(evenly(F.length(text), size), lambda at: F.substring(F.col(text), at, F.lit(size)))
    read = F.when(F.length(text) <= READ, F.col(text)).otherwise(F.array_join(parts, "\n"))
    texts: dict[str, list[str]] = {}
    for r in hash_sample(known.select(doc_id, text, lang), doc_id, lang, sample).select(doc_id, read.alias("read"), lang).orderBy(F.xxhash64("read"), doc_id).collect():
        texts.setdefault(r[2], []).append(r[1])
    filters = Filters.learned(texts)
    return filters.calibrate(texts) if levels else filters


def identify(docs: DataFrame, filters: Filters, text: str = "text", recognised: bool = False) -> DataFrame:
    """Adds lang_pred and score, and recognised where asked for, to the rows, whose other columns pass through."""
    bounded(docs.sparkSession)
    added = ["lang_pred", "score", *(["recognised"] if recognised else [])]
    docs = docs.drop(*added)
    columns = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", lang_pred string, score double" + (", recognised boolean" if recognised else "")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2 MB for each 64 languages

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            texts = b.column(text).to_pylist()
            names, scores = shared.value.judge(texts)
            known = [pa.array(shared.value.recognised(texts), pa.bool_())] if recognised else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), *known], [*columns, *added])

    return docs.mapInArrow(judged, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
