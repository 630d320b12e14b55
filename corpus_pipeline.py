"""A corpus pipeline: each stage works on all that the one before it kept.

Toxic documents go, then documents without a recognised language; one document of each group of near
duplicates stays (the one with the smallest id; rows that repeat an id or have none are documents of their
own, behind those with an id); passages of 200 bytes or more that are repeated go from
the texts; the rest is packed into sequences of 2048 tokens. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import language, neardup, packing, suffixes, toxicity
from llm.common import held_out, stored, table

#: A language has at least this share of the corrected hits (with up to five languages the leading one always
#: has; whether the text is in that language at all is told by language.Filters.recognised).
LEAST_SHARE = 0.2
#: Least Jaccard similarity of near duplicates, in percent, on 5-word shingles.
SIMILAR = 80
#: The column of the ids that told_apart gives.
NODE = "_node"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(docs.columns)


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    filters = language.learn(table(spark, sf_dir, "documents").filter(~held_out()), levels=True)
    judged = language.identify(docs, filters, recognised=True)
    return judged.filter(F.col("recognised") & (F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_SHARE)).select(docs.columns)


def told_apart(docs: DataFrame) -> DataFrame:
    """The rows, each under an id of its own: doc_id for the first row of each id; numbers above all ids for
    the other rows of an id and rows without one, so that copies among them are found like any others."""
    rows = stored(docs.withColumn(NODE, F.monotonically_increasing_id()), "rows")
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(NODE).alias("first"))
    above = firsts.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).cast("long") + 1).first()[0]
    named = rows.filter("doc_id IS NOT NULL").join(firsts.hint("merge"), "doc_id")
    node = F.when(F.col("first") == F.col(NODE), F.col("doc_id").cast("long")).otherwise(F.lit(above) + F.col(NODE))
    return named.withColumn(NODE, node).drop("first").unionByName(rows.filter("doc_id IS NULL").withColumn(NODE, F.lit(above) + F.col(NODE)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").limit(1).count():
        rows = told_apart(docs)
        gone = neardup.near_duplicates(rows.select(F.col(NODE).alias("doc_id"), "text"), percent=SIMILAR).filter("NOT kept").select(F.col("doc_id").alias(NODE))
        return rows.join(gone.hint("merge"), NODE, "left_anti").select(docs.columns)
    gone = neardup.near_duplicates(docs, percent=SIMILAR).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)  # the same plan at every size: these ids grow with the input


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(docs, as_text=True).withColumn("text", F.col("kept"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")), keep_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", with_language),
    ("minhash_neardup", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("best_fit_packing", packed),
]
#: SQL can express no trained filter, component search or packing plan.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
