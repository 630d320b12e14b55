"""Each operator against brute force, a round trip or held-out labels, and on awkward rows."""

import hashlib
import os
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm import bpe, chat, language, media, neardup, packing, suffixes, topk, toxicity, urls
from llm.queries import oracle_sql, queries

WORD, BYTE = str(public_tokenizers.path("word_bpe_49k.json")), str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = ["a", "th", "er ", "É", "ß", "İ", "Σ", "e\u0301", "日本", "😀", "'s", "'", "!!", "\u200d", " ", "\n", "\x1c", "\x85", "\xa0", "½", "7", "٣", "_", "ª"]


def made_up(r, pieces=PIECES):
    return "".join(r.choice(pieces) for _ in range(r.choice([0, 1, 3, 20, 200, 900])))


# ---- media


def test_media(spark, docs):
    got = media.media_columns(docs).collect()
    assert len(got) == docs.count()
    for r, text in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), [x.text for x in sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))], strict=True):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        assert media.from_wav(bytes(r.media)) == payload and r.n_bytes == len(data) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_fingerprint_finds_tones():
    t = np.arange(576 * 20)
    tone = lambda k, at: 60 * np.sin(2 * np.pi * k * t / 576) * np.exp(-(((t - at * 288) / 400) ** 2))
    bins, power = media.spectrum_peaks((128 + tone(30, 10)).astype(np.uint8))
    assert bins[power[:, 1].argmax(), 1] == 30 and abs(int(power[:, 1].argmax()) - 9) <= 1
    x = (128 + tone(30, 8) + tone(90, 20)).astype(np.uint8).tobytes()
    codes = media.fingerprint(x)
    assert (np.diff(codes) >= 0).all() and {30, 90} <= {int(c >> 20) & 0xFFF for c in codes} | {int(c >> 8) & 0xFFF for c in codes}
    for c in codes:  # a code's second peak is at most FAR frames after its time
        assert 0 <= c & 0xFF <= media.FAR and 0 <= c >> 32 < len(bins)
    assert (media.fingerprint(x) == codes).all()


def test_fingerprint_by_brute_force():
    """The transform as a sum over samples, peaks and pairs one by one."""
    r = random.Random(13)
    x = bytes(r.randrange(256) for _ in range(576 * 7))
    frames = [[b - 128 for b in x[a : a + 576]] for a in range(0, len(x) - 575, 288)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(576), np.arange(289)) / 576)
    power = np.abs(np.array(frames) @ turn) ** 2
    best = [[max(range(a, b), key=lambda k: (f[k], -k)) for a, b in media.BANDS] for f in power]
    tops = []
    for t, bins in enumerate(best):
        for band, k in enumerate(bins):
            strength = lambda u: power[u][best[u][band]] if 0 <= u < len(best) else 0  # noqa: B023, E731
            if strength(t) >= strength(t - 1) and strength(t) > strength(t + 1):
                tops.append((t, k))
    want = sorted((a << 32) | (j << 20) | (k << 8) | (b - a) for i, (a, j) in enumerate(tops) for b, k in tops[i + 1 : i + 3] if b - a <= 255)
    assert media.fingerprint(x).tolist() == want and len(want) > 20


def test_wave_is_readable(tmp_path):
    (tmp_path / "a.wav").write_bytes(media.to_wav(media.payload_of(b"hello")))
    with wave.open(str(tmp_path / "a.wav")) as w:
        assert w.getnframes() == 576 and w.getsampwidth() == 1


# ---- BPE


def test_word_bpe_is_the_librarys():
    t, b, r = Tokenizer.from_file(WORD), bpe.WordBPE(WORD), random.Random(1)
    for k in range(600):
        text = made_up(r, [*PIECES, "<|endoftext|>"] if k % 9 == 0 else PIECES)
        ids = t.encode(text, add_special_tokens=False).ids
        assert list(b.encode(text)) == ids and b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_byte_bpe_is_the_librarys():
    t, b, r = Tokenizer.from_file(BYTE), bpe.ByteBPE(BYTE, 5000), random.Random(2)
    for k in range(600):
        text = made_up(r, [*PIECES, "<|endoftext|>"] if k % 9 == 0 else PIECES)
        assert b.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_trees_agree_with_the_whole():
    t, b, r = Tokenizer.from_file(WORD), bpe.WordBPE(WORD), random.Random(3)
    for _ in range(25):
        word = "".join(r.choice(["th", "er", "in", "é", "日", "q", "aaa"]) for _ in range(r.choice([200, 2000])))
        assert list(b.tree_tokens(b.normal(word), 32)) == t.encode(word, add_special_tokens=False).ids
        text = b.normal("".join(r.choice(["th", "er ", " ", "'s", "!'", "\n"]) for _ in range(4000)))
        assert bpe.tree_words(text, 64) == bpe.splitter(text).findall(text)
    assert list(b.encode("z" * 100_000)) == t.encode("z" * 100_000, add_special_tokens=False).ids


def test_new_code_points_are_the_librarys():
    t, b = Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    r = random.Random(12)
    some = ["\ua7dc", "\u1c89", "\U00010d50", "\u03a3\u0391\u03a3", "\u0130", "\u1e9e"]
    texts = [*some, *(f"x{c}y {c}" for c in some), *("".join(chr(r.choice([r.randrange(0xA0, 0xD7FF), r.randrange(0xE000, 0x20000)])) for _ in range(40)) for _ in range(200))]
    wrong = [x for x in texts if list(b.encode(x)) != t.encode(x, add_special_tokens=False).ids]
    assert not wrong


def test_bpe_rows(spark, docs):
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in bpe.encode_documents(docs, WORD).collect()}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.ids == ids and g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), WORD).count() == 0


# ---- near duplicates


def brute_groups(rows, percent=85):
    sets = defaultdict(set)
    sizes = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        sizes[i] = len(sets[i])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (sizes[i], find(i)) for i in sets}


def near_rows():
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One two"), (4, "one TWO"), (5, "a b c d e")]
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 8, 11, 12, 30, 200]))]
        for _ in range(r.choice([1, 2, 3, 8])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows) * 7 % 10007, r.choice([" ", "\t"]).join(t)))
    return rows


@pytest.mark.parametrize(("tile", "percent"), [(2048, 85), (3, 85), (3, 80)])
def test_near_duplicates(spark, monkeypatch, tile, percent):
    monkeypatch.setattr(neardup, "TILE_TEXTS", tile)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute_groups(rows, percent)


def test_near_duplicates_of_awkward_rows(spark, docs):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 3 and by[6].component_id == 5 and not by[6].kept and by[11].kept
    assert by[0].n_shingles == by[2].n_shingles == 0 and by[0].component_id == 0 and by[None].kept and by[None].component_id is None
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_queries_by_brute_force(spark, small):
    """op2, op3 and op9 as registered, over a whole table."""
    t = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    ids = {k: t.encode(v or "", add_special_tokens=False).ids for k, v in texts.items()}
    sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
    got = {tuple(r) for r in queries()["op2_bpe_round_trip"](spark, small).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(k, len(v), sha(" ".join(map(str, v))), sha(t.decode(v, skip_special_tokens=False))) for k, v in ids.items()}
    got = {tuple(r) for r in queries()["op3_minhash_neardup"](spark, small).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert got == {(k, n, c, c == k) for k, (n, c) in brute_groups(texts.items()).items()}
    got = {tuple(r) for r in queries()["op9_suffix_dedup"](spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {(k, *v[:3], sha(v[3])) for k, v in zip(texts, brute_repeats(texts.values(), 200), strict=True)}


def thue_morse(letters, k=10):
    out = letters
    for _ in range(k):
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out


def test_words_that_a_polynomial_takes_for_one(spark):
    one, two = thue_morse("ab"), thue_morse("ba")
    assert len(one) == 2048 and one != two
    rows = [(1, one), (2, two), (3, one.upper()), (4, f"{one} a b c d"), (5, f"{two} a b c d")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize("tile", [2, 2048])
def test_bands_shared_by_chance_make_no_clusters(spark, monkeypatch, tile):
    """A chain of texts, each half like the next, shares bands but no link; links hidden behind a smaller id of a band stay."""
    monkeypatch.setattr(neardup, "TILE_TEXTS", tile)
    monkeypatch.setattr(neardup, "bands", lambda registers: np.array([1, 2], np.uint64))  # all share all bands
    r = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    rows, text = [], [r.choice(words) for _ in range(400)]
    for i in range(12):
        text = text[200:] + [r.choice(words) for _ in range(200)]
        rows.append((i, " ".join(text)))
    rows += [(100 + i, f"{t} more") for i, t in rows[5:8]] + [(200 + i, f"{t} again") for i, t in rows[5:6]]
    seen = []
    own = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda docs, clusters, *rest: seen.extend(clusters.collect()) or own(docs, clusters, *rest))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    assert {x.rep: x.cluster for x in seen} == {5: 5, 105: 5, 205: 5, 6: 6, 106: 6, 7: 7, 107: 7}


def test_sketch_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    for share in (0.3, 0.6, 0.85, 0.95):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[r.permutation(len(a))[:n]], r.integers(0, 2**63, len(a) - n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
        guess, used = neardup.estimates(neardup.sketch(a), neardup.sketch(b)[None, :])
        assert used[0] == 512 and abs(guess[0] - share) < 0.15


# ---- language and toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries()["op4_language_id"](spark, d).collect()
    assert len(got) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) / len(test) > 0.97


def test_language_of_awkward_rows(spark, docs):
    f = language.Filters.learned({"aa": ["abcde fghij klmno"] * 3, "bb": ["pqrst uvwxy zzzzz"] * 3})
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, f).collect()}
    assert [got[i][0] for i in (0, 1, 2, 11)] == ["und"] * 4 and got[8][0] == "aa" and got[8][1] == 0
    assert f.judge(["klmno abcde", "pqrst"])[0] == ["aa", "bb"] and language.Filters.learned({}).judge(["abc"])[0] == ["und"]
    many = language.Filters.learned({f"l{k:03}": [f"{chr(0x4E00 + k) * 9} "] for k in range(70)})
    assert many.judge([chr(0x4E00 + 69) * 5])[0] == ["l069"] and language.identify(docs.limit(0), f).count() == 0
    assert language.learn(docs.withColumn("lang", docs["text"].substr(99, 0)).filter("lang = 'x'")).languages == []


def test_letters(spark):
    f = language.Filters.learned({"aa": ["abcde fghij klmno"] * 3, "bb": ["pqrst uvwxy zzzzz"] * 3})
    assert f.judge(["½", "²²", "①", "Ⅷ", "٣", "_", "ª", "ʰ", "漢"])[0] == ["und"] * 6 + ["aa"] * 3


def test_masks_name_all_languages_of_an_ngram():
    texts = {"aa": ["abcd efgh ijkl " * 9], "bb": ["abcd mnop " * 9], "cc": ["qrst " * 9]}
    f = language.Filters.learned(texts)
    code = lambda s: language.grams(np.frombuffer(s, np.uint8))
    assert [int(f.masks(code(x))[0]) for x in (b"abcd", b"efgh", b"mnop", b"qrst")] == [3, 1, 2, 4]


def test_language_by_brute_force():
    """Hits per language, counted n-gram by n-gram."""
    r = random.Random(11)
    texts = {name: ["".join(r.choice(letters) for _ in range(300)) for _ in range(4)] for name, letters in (("aa", "abcde "), ("bb", "defgh "), ("cc", "abij "))}
    f = language.Filters.learned(texts)
    tests = ["".join(r.choice("abcdefghij 1É") for _ in range(r.choice([0, 3, 4, 50]))) for _ in range(30)]
    names, scores = f.judge(tests)
    for t, name, score in zip(tests, names, scores, strict=True):
        data = "".join(c.lower() if c in "abcdefghij" else c if ord(c) > 127 else " " for c in t).encode()
        grams = [data[i : i + 4] for i in range(len(data) - 3)]
        hits = [sum((int(f.masks(language.grams(np.frombuffer(g, np.uint8)))[0]) >> k) & 1 for g in grams) for k in range(3)]
        right = [max(0, (h - len(grams) * q) / (1 - q)) for h, q in zip(hits, f.rates, strict=True)]
        if not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0)
        elif sum(right):
            assert name == f.languages[right.index(max(right))] and score == pytest.approx(max(right) / sum(right))


def test_long_training_texts_are_read_in_passages(spark):
    long = " ".join(["front"] * 30_000 + ["tail"] * 3_000)
    f = language.learn(spark.createDataFrame([(1, long, "aa"), (2, "other words", "bb"), (3, None, "aa"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert f.languages == ["aa", "bb"] and f.judge(["tail tail"])[0] == ["aa"]


def test_many_languages(spark):
    rows = [(i, f"{chr(0x4E00 + i % 150) * 30} ", f"l{i % 150:03}") for i in range(600)]
    f = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(f.languages) == 150 and f.judge([chr(0x4E00 + 149) * 8])[0] == ["l149"]


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries()["op6_toxicity"](spark, d).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got)
    test = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit = sum(p and t for p, t in test)
    assert hit / sum(t for _, t in test) > 0.7 and hit / sum(p for p, _ in test) > 0.7


def said(r, extra, words=[]):
    words = words or words.extend("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(300)) or words
    return " ".join([*(r.choice(words) for _ in range(20)), extra, *(r.choice(words) for _ in range(20))])


def calibrated(toxic, plain):
    """A model from three quarters of the texts, calibrated on the rest."""
    read = lambda texts: [toxicity.words(t) for t in texts]
    model, seen = toxicity.trained(read(toxic[::4] + toxic[1::4] + toxic[2::4]), read(plain[::4] + plain[1::4] + plain[2::4])), np.zeros((2, toxicity.TOP + 1))
    for label, texts in enumerate((plain[3::4], toxic[3::4])):
        np.add.at(seen[label], model.evidence(texts), 1)
    return model.calibrate(seen, len(toxic), len(plain))


def test_toxicity_of_awkward_rows(spark, docs):
    r = random.Random(7)
    toxic, plain = [said(r, "slimebag") for _ in range(60)], [said(r, "friend") for _ in range(200)]
    model = calibrated(toxic, plain)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 13 and all(0 <= s <= 1 for s in got.values()) and got[0] == got[1] == got[11]
    assert model.score("such a slimebag") > 0.3 > model.score("such a friend")
    assert toxicity.trained([], [["a"]]).score("slimebag") == 0 and toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert len(set(model.scores(["", None, "1 2 3", "!"]))) == 1 and len(set(model.scores(["x" * 500] * 2))) == 1


def test_toxic_dictionary_decides():
    """Both dictionaries are trained ones, used whole: a word list in the toxic one's place gives other evidence."""
    r = random.Random(9)
    toxic, plain = [said(r, r.choice(["slimebag", "you utter dunce", "rotten to the core"])) for _ in range(90)], [said(r, "friend") for _ in range(300)]
    model = calibrated(toxic, plain)
    listed = toxicity.Distance(model.ordinary, b" slimebag dunce rotten ", model.chances)
    texts = [said(r, x) for x in ["slimebag", "you utter dunce", "rotten to the core", "friend"] for _ in range(10)]
    assert (model.scores(texts[:30]) >= 0.3).mean() > 0.8 and (model.scores(texts[30:]) < 0.3).all()
    assert (listed.evidence(texts) != model.evidence(texts)).any() and ((listed.scores(texts) >= 0.3) != (model.scores(texts) >= 0.3)).any()


def test_windows_by_brute_force():
    r = random.Random(3)
    texts = [[], ["a"], ["ab", "c", "déf"], [r.choice(["aa", "b", "ccc"]) for _ in range(23)], [], ["x"] * 9]
    for step in (1, 2):
        w = toxicity.Windows(texts, step)
        got = [(int(t), x.decode()) for t, x in zip(w.text, w.cut(np.arange(len(w.starts))), strict=True)]
        assert got == [(k, f" {' '.join(t[i : i + toxicity.WINDOW])} ") for k, t in enumerate(texts) for i in range(0, len(t), step)]
        one, two = toxicity.compressor(b"some words"), toxicity.compressor(b"ccc aa b ccc aa b")
        pad = b"\n" * toxicity.PAD
        lengths = [len(one.compress(x.encode() + pad)) - len(two.compress(x.encode() + pad)) for _, x in got]
        assert w.saved(one, two).tolist() == lengths
        over = -(-toxicity.WINDOW // step)
        assert w.summed(np.array(lengths)).tolist() == [sum(lengths[j] for j in range(max(0, i - over + 1), i + 1) if got[j][0] == got[i][0]) for i in range(len(got))]


def test_windows_that_are_not_compressed(spark):
    """They have no string that only the toxic dictionary has, looked for one by one; nearly none would have a distance."""
    r = random.Random(10)
    toxic, plain = [said(r, r.choice(["slimebag", "you utter dunce"])) for _ in range(90)], [said(r, "friend") for _ in range(300)]
    model = calibrated(toxic, plain)
    w = toxicity.Windows([toxicity.words(t) for t in [*toxic[:20], *plain[:20], "", "ab", "x" * 100]])
    own, known = model.toxic + model.ordinary[:10], model.ordinary
    want = [any(x[i : i + n] in own and x[i : i + n] not in known for n in toxicity.STRINGS for i in range(len(x) - n + 1)) for x in w.cut(np.arange(len(w.starts)))]
    assert model.worth(w).tolist() == want and 0 < sum(want) < len(want)
    saved = w.saved(*model.compressors())
    assert (saved[~np.array(want)] != 0).sum() <= 0.01 * (saved != 0).sum()


def test_toxicity_probabilities_rise():
    model, seen = toxicity.Distance(b"x", b"y"), np.zeros((2, toxicity.TOP + 1))
    seen[0, :6], seen[1, :6] = [50, 20, 5, 9, 1, 0], [1, 2, 3, 1, 9, 0]
    model.calibrate(seen, 100, 900)
    assert (np.diff(model.chances) >= 0).all() and 0 < model.chances[0] < 0.05 and model.chances[2] == model.chances[3] and model.chances[3] < model.chances[4] <= model.chances[-1] < 1


def test_toxicity_is_calibrated_on_all_labels(spark):
    """A bounded sample holds one toxic text in four; among the labels it is one in ten, half of them without a sign."""
    r = random.Random(8)
    rows = [(i, said(r, "slimebag" if i % 20 == 0 else "friend"), int(i % 10 == 0)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    few, whole = (toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), n) for n in (75, 2500))
    for model in (few, whole):
        assert model.score(said(r, "slimebag")) > 0.6 and 0.02 < model.score(said(r, "friend")) < 0.1  # 0.05 / 0.95


def test_toxicity_reads_all_parts_of_a_text():
    found = [str(i) for i in range(1000)]
    got = toxicity.passages(found, 120)
    assert [p[0] for p in got] == ["0", "320", "640"] and all(len(p) == 40 for p in got)
    assert sum(toxicity.passages(found), []) == found and toxicity.passages([]) == []
    assert toxicity.unlike([["a", "b", "c", "d"], ["a", "b", "c", "d"], ["x", "y"], []]) == [0, 2, 3]


def test_labels_that_repeat_or_are_null(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, said(r, "slimebag" if i < 80 else "friend")) for i in range(300)], "doc_id long, text string")
    plain = spark.createDataFrame([(i, int(i < 80)) for i in range(300)], "doc_id long, toxic int")
    awkward = plain.unionByName(spark.createDataFrame([(i, 0) for i in range(20)] + [(7, None), (None, 1)], "doc_id long, toxic int"))
    one, two = toxicity.learn(docs, plain), toxicity.learn(docs, awkward)
    assert one.ordinary == two.ordinary and one.toxic == two.toxic and (one.chances == two.chances).all()
    assert toxicity.learn(docs, plain.filter("toxic = 0")).score("slimebag") == 0


def test_toxic_dictionaries_are_trained_in_a_task(spark, monkeypatch):
    """The driver gets the dictionaries, not the sample's texts: it trains nothing itself."""
    r = random.Random(5)
    docs = spark.createDataFrame([(i, said(r, "slimebag" if i < 80 else "friend")) for i in range(300)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(300)], "doc_id int, toxic int")

    driver, own = os.getpid(), toxicity.trained

    def elsewhere(*words):
        assert os.getpid() != driver
        return own(*words)

    monkeypatch.setattr(toxicity, "trained", elsewhere)
    model = toxicity.learn(docs, labels)
    assert model.score("such a slimebag") > 0.3 > model.score("such a friend")
    assert toxicity.learn(docs.filter("doc_id < 0"), labels).score("slimebag") < 0.3


# ---- chats


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\h<#</turn>\n### User: x"), (2, 0, "assistant", "first"), (3, 0, None, None), (3, None, "a: b", ""), (None, 0, "user", "\\"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 1, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    back = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert back == {1: [("user", "hi"), ("assistant", "\\h<#</turn>\n### User: x")], 2: [("assistant", "first")], 3: [("a: b", ""), ("", "")], None: [("user", "\\")], 4: [("system", "s"), ("user", "u"), ("user", "u")]}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: True, 4: False}
    assert got[1].loss_texts == ["\\h<#</turn>\n### User: x"] and got[1].formatted.count("</turn>\n") == 2
    assert chat.parse_chats(chat.format_chats(df.limit(0))).count() == 0


def test_long_chats_take_linear_time(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('say # ', id) AS text")
        began = time.time()
        r = chat.parse_chats(chat.format_chats(rows)).selectExpr("size(turns) AS n", "size(loss_texts) AS m", "valid", "loss_texts[1] AS one").first()
        assert (r.n, r.m, r.valid, r.one) == (n, n // 2, True, "say # 3")
        return time.time() - began

    seconds(500)
    assert seconds(16_000) < 8 * max(0.5, seconds(4_000))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = queries()[name](spark, small)
    cursor = con.execute(oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(str, (tuple(dict(zip(names, r, strict=True))[c] for c in df.columns) for r in cursor.fetchall())))
    assert sorted(str(tuple(r)) for r in df.collect()) == want


# ---- packing


def test_packing(spark, small):
    t = Tokenizer.from_file(BYTE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = sorted(queries()["op7_best_fit_packing"](spark, small).collect(), key=lambda r: (r.sequence_id, r.offset))
    ids = {k: t.encode(v or "", add_special_tokens=False).ids + [0] for k, v in texts.items()}
    cut = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        cut[r.doc_id].append((r.start, r.piece, r.length))
    for k, parts in cut.items():
        parts.sort()
        assert [p[1] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids[k]) and all(p[2] == 2048 for p in parts[1:])
    ends = {}
    for r in got:
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert set(cut) == set(ids) and max(ends.values()) <= 2048 and len(ends) <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_plans():
    r = random.Random(4)
    for size in (16, 100, 512):
        for _ in range(10):
            h = Counter(r.randrange(1, size + 1) for _ in range(r.choice([1, 5, 300])))
            used = Counter()
            for lengths, n in packing.plan(h, size):
                assert sum(lengths) <= size and n > 0
                for x in lengths:
                    used[x] += n
            assert used == h
    assert packing.plan({}, 10) == [] and sum(n for _, n in packing.plan({600: 1000, 848: 1000, 1200: 500}, 2048)) <= 1000


def test_packing_of_awkward_rows(spark, docs):
    got = packing.pack_documents(docs, BYTE, 64).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()} and {r.length for r in got if r.doc_id in (0, 1)} == {1}
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and packing.pack_documents(docs.limit(0), BYTE).count() == 0


# ---- urls


def test_urls(spark):
    table = ["http://A.Example.NET/en/1?x", "https://net/x", "http://b.org/fr/", "ftp://x.org/de", "http://a.example.com/de/9#f", "http://example.com", "nothing", None, "http://ads-track.example.com/en/40", "http://xnet/", "http://a.net?q", "https://thther.example.org/en/5"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(table)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge_urls(rows).collect()}
    assert [got[i].host for i in range(8)] == ["a.example.net", "net", "b.org", "x.org", "a.example.com", "example.com", "", ""]
    assert [got[i].rule for i in range(12)] == ["example.net/en/", "net/", "org/fr/", None, "example.com/de/", None, None, None, None, None, None, None]
    assert [got[i].verdict for i in (0, 1, 2, 4)] == ["allow", "block", "allow", "block"] and got[8].verdict == "block" and got[11].verdict == "allow"
    weights = brute_url_model()
    for r in got.values():
        if r.rule is None:
            p = brute_url_probability(weights, r.host, r.path)
            assert r.p_block == pytest.approx(p, abs=1e-9) and r.verdict == ("block" if p >= 0.5 else "allow")
        else:
            assert r.p_block is None
    assert urls.judge_urls(rows.limit(0)).count() == 0
    assert np.mean([(brute_url_probability(weights, h, p) >= 0.5) == bool(y) for h, p, y in urls.LABELLED]) > 0.95
    assert "Scan" not in "".join(x for x in urls.judge_urls(rows)._jdf.queryExecution().executedPlan().toString().split("Scan")[2:])  # one scan


def brute_url_slots(host, path):
    out = set()
    for mark, s in ((1, f"^{host}$".encode()), (2, f"^{path}$".encode())):
        for n in (3, 4, 5):
            for i in range(len(s) - n + 1):
                out.add(((int.from_bytes(bytes([mark * 8 + n]) + s[i : i + n], "big") * 0x9E3779B97F4A7C15) % 2**64) >> 50)
    return out


def brute_url_model():
    """Gradient descent, weight by weight."""
    rows = [(brute_url_slots(h, p), y) for h, p, y in urls.LABELLED]
    w, bias = defaultdict(float), 0.0
    for _ in range(300):
        step, up = defaultdict(float), 0.0
        for slots, y in rows:
            error = (1 / (1 + np.exp(-(sum(w[s] for s in slots) / len(slots) ** 0.5 + bias))) - y) / len(rows)
            up += error
            for s in slots:
                step[s] += error / len(slots) ** 0.5
        for s in set(step) | set(w):
            w[s] -= 2.0 * (step[s] + 1e-3 * w[s])
        bias -= 2.0 * (up + 1e-3 * bias)
    return w, bias


def brute_url_probability(model, host, path):
    w, bias = model
    slots = brute_url_slots(host, path)
    return 1 / (1 + np.exp(-((sum(w[s] for s in slots) / len(slots) ** 0.5 if slots else 0.0) + bias)))


def test_long_urls(spark):
    long = "http://ads-track.example.org/" + "ab/" * 50_000
    r = urls.judge_urls(spark.createDataFrame([(1, long), (1, long), (2, "http://h/?#")], "page_id long, url string")).collect()
    assert [len(x.path) for x in r] == [150_001, 150_001, 1] and r[0].p_block == r[1].p_block


# ---- repeated passages


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if counts[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(x), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), bytes(a for a, k in zip(x, gone, strict=True) if not k)))
    return out


@pytest.mark.parametrize("length, chunk", [(200, 3000), (20, 2000), (200, 1 << 20)])
def test_repeats(spark, length, chunk):
    r = random.Random(5)
    rnd = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    base = [rnd(r.choice([50, 199, 200, 201, 400, 900])) for _ in range(12)]
    texts = [None, "", "a" * 700, "a" * 200, "b" * 201]
    for _ in range(90):
        t = ""
        for _ in range(r.choice([0, 1, 2, 4])):
            x = r.choice(base)
            a = r.randrange(len(x))
            t += x[a : a + r.choice([30, 150, 198, 199, 200, 201, 260, 500])] + rnd(r.choice([0, 1, 40]))
        texts.append(t)
    texts += [texts[7], texts[7]]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(5)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixes.remove_repeats(df, length, chunk=chunk).collect()}
    assert got == dict(enumerate(brute_repeats(texts, length)))


def test_covers_are_difference_covers():
    for m, d in suffixes.COVERS.items():
        assert {(a - b) % m for a in d for b in d} == set(range(m))


def test_equal_names_of_different_texts_are_told_apart():
    order, new = suffixes.sorted_groups(np.array([5, 5, 5, 1], np.uint64), np.array([2, 1, 2, 9], np.uint32))
    assert sorted(np.add.reduceat(np.ones(4, int), np.flatnonzero(new)).tolist()) == [1, 1, 2]


def test_repeats_of_awkward_rows(spark, docs):
    got = suffixes.remove_repeats(docs, as_text=True)
    assert got.count() == docs.count() and got.columns == ["doc_id", "lang", "source", "score", "kept", "n_bytes", "n_removed", "n_spans"]
    assert {r.doc_id for r in got.filter("n_removed > 0").collect()} == {8, 9} and suffixes.remove_repeats(docs.limit(0)).count() == 0


# ---- search


def test_topk(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-1.5, 0.0, 0.25, 0.9]) for _ in range(r.choice([3, 4, 4]))]) for i in range(150)]
    rows += [(200, None), (300, [1.0, None]), (400, [float("nan")]), (500, [float("inf")]), (600, []), (7, [9.0, 9.0]), (None, [1.0])]
    rows += [(0, [0.25, 0.25]), (50, rows[50][1]), (33, [2.0])]  # ids that repeat, of queries and of others
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    got = [tuple(x) for x in topk.top_k(df, 5, 50).select("query_id", "rank", "vec_id", "score").collect()]
    assert before == {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in before}
    good = [(i, [int(np.floor(1024 * float(np.float32(v)))) for v in e]) for i, e in rows if i is not None and e and all(v is not None and np.isfinite(v) for v in e)]
    want = []
    for own, (q, a) in enumerate(good):
        if q % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for k, (i, b) in enumerate(good) if k != own)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.accumulate(np.array([2**40]), np.array([[2**21, -(2**21)]])).tolist() == [2**61, -(2**61)]
    with pytest.raises(OverflowError):
        topk.accumulate(np.array([2**50]), np.array([[2**50]]))


def test_topk_blocks(spark):
    """Blocks are full whatever the session's batches, and bounded in bytes."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("id AS vec_id", "array(1L, id) AS v")
    sizes = sorted(len(r.ids) // 8 for r in topk.packed(rows, topk.QUERY_BLOCK).collect())
    assert sizes == [952, 1024, 1024]
    wide = spark.range(0, 9, 1, 1).selectExpr("id AS vec_id", "sequence(1L, 1000000L) AS v")
    assert sorted(len(r.ids) // 8 for r in topk.packed(wide, topk.QUERY_BLOCK).collect()) == [1, 2, 2, 2, 2]


def test_topk_broadcasts_nothing(spark, monkeypatch):
    """A broadcast takes the query blocks through the driver, as often as there are partitions. Narrow numbers and cells give the same scores."""
    r = random.Random(11)
    df = spark.createDataFrame([(i, [r.uniform(-1, 1) * (3000 if i % 7 == 0 else 1) for _ in range(5)]) for i in range(400)], "vec_id long, embedding array<float>").repartition(3)
    plans, own = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda x, label: plans.append(x._jdf.queryExecution().executedPlan().toString()) or own(x, label))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 32)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    for every in (1, 20):
        got = sorted(tuple(x) for x in topk.top_k(df, 3, every).select("query_id", "rank", "vec_id", "score").collect())
        v = {x.vec_id: np.floor(1024 * np.array(x.embedding)).astype(np.int64) for x in df.collect()}
        want = [(q, n + 1, i, -s) for q in v if q % every == 0 for n, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:3])]
        assert got == sorted(want)
    assert "Join" in plans[-1] and not any("Broadcast" in p for p in plans)
    assert topk.grid(600, 100, 1) == (300, 2) and topk.grid(100, 7, 7) == (10, 10) and topk.grid(12, 0, 0) == (12, 1)


def test_topk_sql_tells_repeated_ids_apart(spark, tmp_path):
    rows = [(0, [1.0, 2.0]), (0, [3.0, -1.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5]), (7, [1.0]), (None, [9.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(con.execute(topk.SQL).fetchall()) == sorted(tuple(r) for r in topk.op10_exact_topk(spark, str(tmp_path)).collect())


def test_passages_of_the_longest_training_texts(spark):
    """19 x the length passed 32 bits from 113 million characters on, an error; usual lengths begin where they did."""
    rows = spark.createDataFrame([(n,) for n in (20_001, 123_457, 200_000_000, 2_000_000_000)], "n int")
    got = {r[0]: r[1] for r in rows.select("n", language.evenly(rows.n, 1000)).collect()}
    assert got == {n: [int(i * (n - 1000) / 19) + 1 for i in range(20)] for n in got}
