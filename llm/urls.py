"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is trained on ``LABELLED`` (a small table kept here), by full-batch gradient descent with
a fixed number of steps, so that it is the same on every machine.

Defined results: a null url, or one without ``://``, has empty host and path and is judged by the
model on the empty string; no row is dropped; urls of any length are read whole; repeated rows get the same verdict; extra
columns pass through, but for those named like an output, which the output replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path start)
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: Fixed training rows: (host, path, 1 for block).
LABELLED = [
    ("www.ads-track.example.com", "/en/1", 1), ("m.ads-track.example.com", "/en/77", 1), ("ads-track.example.com", "/fr/12.html", 1),
    ("ads.banner.example.org", "/click/55", 1), ("track.pixel.example.com", "/beacon.gif", 1), ("cdn.adserver.example.com", "/ad.js", 1),
    ("click.track.example.org", "/redirect", 1), ("casino-bonus.example.com", "/win/now", 1), ("cheap-pills.example.com", "/buy/1", 1),
    ("free-spins.example.org", "/casino/9", 1), ("stats.tracker.example.com", "/collect", 1), ("popup-ads.example.com", "/en/9", 1),
    ("adclick.example.org", "/es/3", 1), ("doubleads.example.com", "/fr/8", 1), ("affiliate.example.com", "/offer/77", 1),
    ("spam.example.com", "/login/verify", 1), ("ads-track.example.org", "/en/8", 1), ("banner-ads.example.org", "/es/40", 1),
    ("theran.example.com", "/en/825", 0), ("www.thther.example.com", "/fr/17.html", 0), ("m.ththin.example.org", "/en/685", 0),
    ("tionsh.example.org", "/es/2", 0), ("therha.example.com", "/es/676", 0), ("www.example.com", "/en/1/", 0),
    ("news.example.org", "/en/article/77", 0), ("docs.example.com", "/guide/start", 0), ("wiki.example.org", "/page/Main", 0),
    ("library.example.org", "/books/12", 0), ("blog.example.com", "/2020/01/post.html", 0), ("school.example.org", "/course/4", 0),
    ("www.therth.example.org", "/en/34431", 0), ("ththth.example.com", "/fr/25", 0), ("ththan.example.com", "/en/9", 0),
    ("thther.example.org", "/de/77", 0), ("m.therha.example.org", "/en/281.html", 0), ("museum.example.com", "/fr/9", 0),
]

BITS, NGRAMS = 14, (3, 4, 5)


def slots_of(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct n-grams (of UTF-8 bytes) of each row's host and path; both are set between ``^`` and
    ``$``, and an n-gram is marked by which of them it is from."""
    rows, slots = [], []
    for mark, column in ((1, hosts), (2, paths)):
        data = [b"^%s$" % x.encode("utf-8", "surrogatepass") for x in column]
        ends = np.cumsum([len(d) for d in data])
        x = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(data)), [len(d) for d in data])
        for n in NGRAMS:
            at = np.arange(max(0, len(x) - n + 1))
            at = at[at + n <= ends[row[at]]]
            code = np.full(len(at), mark * 8 + n, np.uint64)
            for i in range(n):
                code = code * np.uint64(256) + x[at + i]
            rows.append(row[at])
            slots.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
    row, slot = np.concatenate(rows), np.concatenate(slots)
    both = np.unique(row << BITS | slot)
    return both >> BITS, both & ((1 << BITS) - 1)


def train(labelled: list[tuple[str, str, int]] = LABELLED, steps: int = 300, rate: float = 2.0, l2: float = 1e-3) -> np.ndarray:
    """Weights of the slots and, last, the bias."""
    row, slot = slots_of([r[0] for r in labelled], [r[1] for r in labelled])
    x = np.zeros((len(labelled), (1 << BITS) + 1))
    x[row, slot] = 1
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    x[:, -1] = 1
    y, w = np.array([r[2] for r in labelled], float), np.zeros(x.shape[1])
    for _ in range(steps):
        w -= rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + l2 * w)
    return w


def probabilities(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    row, slot = slots_of(hosts, paths)
    sums, n = np.bincount(row, weights=w[slot], minlength=len(hosts)), np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-(sums / np.sqrt(np.maximum(1, n)) + w[-1])))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(rows: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict and p_block (null where a rule decides)."""
    weights = train()

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:  # null where a rule decides: the model runs only over the rest
            out, asked = np.full(len(hosts), np.nan), np.flatnonzero(hosts.notna().to_numpy())
            for k in range(0, len(asked), 1000):
                some = asked[k : k + 1000]
                out[some] = probabilities(weights, hosts.iloc[some].tolist(), paths.iloc[some].tolist())
            yield pd.Series(out)

    out = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule overrides
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    ruled = out.withColumns({"rule": rule, "verdict": said})
    asked = F.col("rule").isNull()
    judged = ruled.withColumn("p_block", F.nanvl(scored(F.when(asked, F.col("host")), F.when(asked, F.col("path"))), F.lit(None).cast("double")))
    return judged.withColumn("verdict", F.when(~asked, F.col("verdict")).when(F.col("p_block") >= threshold, "block").otherwise("allow"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")
