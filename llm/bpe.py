"""BPE encoding and decoding with the vocabulary files of public tokenizers.

Long unsplit text is encoded as a tree: its halves are encoded in parallel, and at each join a window
around it is encoded again and grown until both sides agree with it exactly.

* A *text* longer than ``LEAF`` characters is a tree of pieces split into words. The window runs from a
  word that follows white space to a word that white space follows; both sides agree when the window
  starts with the left side's word and ends with the right side's word. White space resets the
  splitter, so the words in between are those of the whole text.
* A *word* longer than ``LONG_WORD`` bytes is a tree of token sequences. Both sides agree when the
  window's tokens share a token, at the same place, with the left tokens and with the right ones. A
  token sequence is the BPE encoding of its text exactly when every adjacent pair of tokens is that of
  its own text; each pair lies in one of the three sequences, so the join is exact.

Shorter words go through the ranks in one call.

Defined results: null text is the empty text, which has no tokens; texts of any length are encoded
whole; special tokens' strings are special as in the library (a text holding one is encoded by the
library itself); repeated rows give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded, parts_of, table

LEAF, LONG_WORD, KEPT_WORDS, THREADS = 8192, 256, 300_000, 4
#: The splitter of the word vocabulary, as its file states it, and the same over ASCII letters.
#: White space is Unicode's (Python's \s also takes in \x1c to \x1f).
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_LATIN, LETTER_LATIN, NUMBER_LATIN = r"\t-\r \x85\xa0", r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER_LATIN}]+|[{NUMBER_LATIN}]|[^{BLANK_LATIN}{LETTER_LATIN}{NUMBER_LATIN}]+")
#: The same for the byte-level vocabulary, whose words may start with a space and which keeps white space.
LATIN_BYTE_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER_LATIN}]+| ?[{NUMBER_LATIN}]+| ?[^{BLANK_LATIN}{LETTER_LATIN}{NUMBER_LATIN}]+|[{BLANK_LATIN}]+(?![^{BLANK_LATIN}])|[{BLANK_LATIN}]+"
)
IS_BLANK = re.compile(f"[{BLANK}]")
NOT_LATIN = re.compile("[^\x00-\xff]")


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


@cache
def classes() -> tuple[str, str]:
    """Letters and numbers as sets of the regex module, mended by what the library takes for such: the two know
    different versions of Unicode."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = []
    for name in (r"\p{L}", r"\p{N}"):
        theirs = {c for x, _ in Split(Regex(name), "removed", invert=True).pre_tokenize_str(every) for c in x}
        ours = set(regex.findall(name, every))
        spelled = lambda some: "".join(f"\\U{ord(c):08x}" for c in sorted(some))
        kept = f"[{name}--[{spelled(ours - theirs)}]]" if ours - theirs else name
        out.append(f"[{kept}||[{spelled(theirs - ours)}]]" if theirs - ours else f"[{kept}]")
    return out[0], out[1]


@cache
def any_words(of_bytes: bool):
    """The splitters over all letters."""
    letter, number = classes()
    other = f"[[^{BLANK}]--{letter}--{number}]"
    if of_bytes:
        return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+", regex.V1)
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}+", regex.V1)


def splitter(text: str):
    return any_words(False) if NOT_LATIN.search(text) else LATIN_WORDS


def tree_words(text: str, leaf: int = LEAF) -> list[str]:
    """The words of ``text``, by halves."""
    return [w for _, w in _word_tree(text, 0, len(text), splitter(text), leaf)]


def _spans(text: str, a: int, b: int, split) -> list[tuple[int, str]]:
    return [(a + m.start(), m.group()) for m in split.finditer(text[a:b])]


def _word_tree(text: str, a: int, b: int, split, leaf: int) -> list[tuple[int, str]]:
    if b - a <= leaf:
        return _spans(text, a, b, split)
    mid = (a + b) // 2
    left, right = _word_tree(text, a, mid, split, leaf), _word_tree(text, mid, b, split, leaf)
    reach = 4
    while True:
        i, j = max(0, len(left) - reach), min(len(right), reach)
        while i > 0 and not IS_BLANK.match(text[left[i][0] - 1]):
            i -= 1
        while j < len(right) and not IS_BLANK.match(text[right[j - 1][0] + len(right[j - 1][1])]):
            j += 1
        start, end = (left[i][0] if i else a), (right[j - 1][0] + len(right[j - 1][1]) if 0 < j < len(right) else b)
        window = _spans(text, start, end, split)
        agree_left = i == 0 or window and window[0] == left[i]
        agree_right = j == len(right) or window and window[-1] == right[j - 1]
        if agree_left and agree_right:
            return left[:i] + window + right[j:]
        reach *= 2


class WordBPE:
    """Encoder and decoder of the lower-casing word vocabulary.

    Words are encoded by ranks: a word's last letter is one symbol with its end mark, written here as
    a trailing space (no word holds one), so each token's rank is its id and a whole list of words is
    encoded in one call.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.tokens = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        self.size = [len(t.removesuffix("</w>")) for t in self.tokens]
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in vocabulary.items() if t not in self.specials}
        self.ranked = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def normal(self, text: str) -> str:
        if NOT_LATIN.search(text):
            return self.whole.normalizer.normalize_str(text)  # the file's own, whose Unicode is newer than Python's
        return text.lower()

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.specials):
            return self.whole.encode(text, add_special_tokens=False).ids
        text = self.normal(text)
        words = splitter(text).findall(text) if len(text) <= LEAF else tree_words(text)
        if not words:
            return []
        if max(map(len, words)) * 4 <= LONG_WORD:
            return self._flat(" ".join(words))
        return [i for w in words for i in (self._flat(w) if len(w) * 4 <= LONG_WORD else self.tree_tokens(w))]

    def _flat(self, words: str) -> list[int]:
        return self.ranked.encode_ordinary(words + " ")

    def tree_tokens(self, word: str, leaf: int = LONG_WORD) -> list[int]:
        """Tokens of one unsplit word: its leaves, halves of halves cut between characters, are encoded in parallel (the
        ranks are native code that threads share), then level by level all neighbours are joined in parallel."""
        parts = [word]
        while max(map(len, parts)) > max(2, leaf // 4):
            parts = [x for p in parts for x in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > 1 else (p,))]
        data = word.encode()
        ends = np.cumsum([len(p.encode()) for p in parts]).tolist()
        with ThreadPoolExecutor(THREADS) as pool:
            level = [(tokens, a, b) for tokens, a, b in zip(pool.map(self._flat, parts), [0, *ends], ends, strict=False)]
            while len(level) > 1:
                odd = [level.pop()] if len(level) % 2 else []
                level = [*pool.map(lambda pair: self._join(data, *pair), zip(level[::2], level[1::2], strict=True)), *odd]
        return level[0][0]

    def _join(self, whole: bytes, one: tuple, two: tuple) -> tuple[list[int], int, int]:
        """The tokens of two neighbouring stretches (tokens, begin, end) as those of one."""
        (left, begin, middle), (right, _, finish) = one, two
        data, cut = whole[begin:finish], middle - begin
        lefts, rights, reach = self._starts(left, 0), self._starts(right, cut), 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            start = lefts[a] if a < len(left) else cut
            end = rights[b] if b < len(right) else len(data)
            while start > 0 and data[start] & 0xC0 == 0x80:  # windows start and end between characters
                a -= 1
                start = lefts[a]
            while end < len(data) and data[end] & 0xC0 == 0x80:
                b += 1
                end = rights[b] if b < len(right) else len(data)
            window = self._flat(data[start:end].decode())
            joined = self._joined(left, lefts, right, rights, window, self._starts(window, start), start == 0, end == len(data))
            if joined is not None:
                return joined, begin, finish
            reach *= 2

    def _starts(self, ids: list[int], at: int) -> list[int]:
        out = []
        for i in ids:
            out.append(at)
            at += self.size[i]
        return out

    @staticmethod
    def _joined(left, lefts, right, rights, window, at, from_start, to_end):
        """left[:i] + window[i2:j2] + right[j:] where tokens are shared on both sides, else None."""
        was, will = dict(zip(lefts, range(len(left)), strict=True)), dict(zip(rights, range(len(right)), strict=True))
        first = (0, 0) if from_start else next(((was[p], k) for k, p in enumerate(at) if p in was and left[was[p]] == window[k] and was[p] < len(left) - 1), None)
        last = (len(right), len(window)) if to_end else next(((will[at[k]], k) for k in range(len(window) - 2, -1, -1) if at[k] in will and right[will[at[k]]] == window[k] and will[at[k]] > 0), None)
        if first is None or last is None or first[1] > last[1]:
            return None
        return [*left[: first[0]], *window[first[1] : last[1]], *right[last[0] :]]

    def decode(self, ids) -> str:
        """As the library without a decoder: the tokens joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


class ByteBPE:
    """Encoder of the byte-level vocabulary; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.whole.get_vocab(with_added_tokens=True).items() if t not in self.specials}
        self.ranked = tiktoken.Encoding("bytes", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.kept, self.words = kept, {}

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = (any_words(True) if NOT_LATIN.search(text) else LATIN_BYTE_WORDS).findall(text)
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) + len(words) > self.kept:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = np.array(self.ranked(w.encode()), "<u4").tobytes()
            return b"".join(map(known.__getitem__, words))


_LOADED: dict[tuple[type, str], object] = {}


def loaded(path: str, kind: type = WordBPE):
    """One encoder per worker process and vocabulary."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """doc_id, ids (null unless kept), n_tokens, ids_sha256, decoded (null unless kept), decoded_sha256."""
    bounded(docs.sparkSession)
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        digits = [str(i) for i in range(len(bpe.tokens))]
        for b in parts_of(batches):
            columns: list[list] = [[], [], [], [], []]
            for t in b.column("text").to_pylist():
                ids = bpe.encode(t)
                decoded = bpe.decode(ids)
                row = (list(ids) if keep else None, len(ids), hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest(), decoded if keep else None, hashlib.sha256(decoded.encode()).hexdigest())
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = (pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(made, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string")


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), keep=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
