import random

import corpus_pipeline
from llm import language, toxicity
from llm.common import held_out, table
from tests.llm.test_small import brute_groups, brute_repeats


def test_stages(spark, small, tmp_path):
    """Each stage against what the one before it kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
    assert all(d.columns == columns for d in kept[:-1])
    rows = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    model = toxicity.learn(table(spark, small, "documents"), table(spark, small, "labels"))
    assert set(rows[0]) == {i for i, t in before.items() if model.score(t) < 0.3}
    filters = language.learn(table(spark, small, "documents").filter(~held_out()))
    ids = list(rows[0])
    names, scores = filters.judge([rows[0][i] for i in ids])
    assert set(rows[1]) == {i for i, n, s in zip(ids, names, scores, strict=True) if n != "und" and s >= corpus_pipeline.LEAST_SHARE}
    assert set(rows[2]) == {i for i, (_, c) in brute_groups(rows[1].items(), corpus_pipeline.SIMILAR).items() if c == i}
    ids = list(rows[2])
    want = dict(zip(ids, (r[3].decode(errors="ignore") for r in brute_repeats([rows[2][i] for i in ids], 200)), strict=True))
    assert rows[3] == want
    assert {r.doc_id for r in kept[-1].collect()} == set(want)


def test_empty(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_awkward_rows(spark, small, docs):
    whole = docs.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) AS n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        whole = stage(spark, whole, small)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_texts_in_no_learned_language_go(spark, small):
    """Noise and prose of languages not learned go, though some n-grams hit; clean texts stay."""
    r = random.Random(3)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(20)]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "1234 5678 " * 40 + "xq zvkj wqpf",
    ]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    planted = spark.createDataFrame([(-1 - k, t, "en", "planted", len(t)) for k, t in enumerate(noise + other)], docs.schema)
    whole = docs.unionByName(planted)
    filters = language.learn(docs.filter(~held_out()))
    names, scores = filters.judge(noise + other)
    assert min(scores) > corpus_pipeline.LEAST_SHARE  # the share alone lets them pass
    got = {x.doc_id for x in corpus_pipeline.with_language(spark, whole, small).collect()}
    assert got == {x.doc_id for x in docs.collect() if len(x.text or "") >= 4}
    assert language.Filters.learned({}).recognised(["abc"]) == [False]


def test_one_copy_stays_where_ids_repeat_or_are_null(spark, small):
    r = random.Random(4)
    long = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, d = long(), long(), long(), long()
    rows = [(5, a), (5, a), (None, b), (None, b), (7, c), (None, c), (9, d), (9, long()), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, small)
    whole = sorted(((x.doc_id or 0, x.text or "") for x in corpus_pipeline.without_repeats(spark, kept, small).collect()))
    assert whole == sorted([(5, a), (0, b), (7, c), (9, d), (9, rows[7][1]), (0, ""), (0, "")])
