"""Quality rules judged by document and by host.

A document has measures (words, symbols, repeated lines and word windows) and
rules over them.  Rule failures are then summed by host.  A host's failure rate
is shrunk towards the rates of all hosts by a beta prior fitted to them by
moments, so that hosts with few documents are not judged by chance; a host whose
shrunk rate is over `max_host_rate` is rejected with all its documents.

Base rules: fewer than 10 words; over 20 % of the words in 5-word windows that
occur twice or more.  Rules that count towards a host only: symbols over 10 % of
the word characters; over 30 % repeated lines.

Defined results: null and empty texts have no words, so they fail; texts of any
length are measured in full; rows with a null host are judged on their own only,
rows without doc_id like any other; repeated rows each count and each stay or go;
hosts with equal rates have equal verdicts; an empty table gives no rows.
`documents_kept` keeps all columns, whatever their names; `judge` returns its own
columns only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, batch_limits, fresh, measured, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
#: Texts of more words compare windows by sorted numbers instead of a table of tuples.
LONG_TEXT = 20_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words stand in windows of `size` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) <= LONG_TEXT:
        windows = list(zip(*(words[k:] for k in range(size)), strict=False))
        if len(set(windows)) == n:
            return 0
        times = Counter(windows)
        twice = np.fromiter((times[w] > 1 for w in windows), bool, n)
    else:
        ids: dict[bytes, int] = {}
        first = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        both = first
        for k in range(1, size):  # numbers of windows of k + 1 words, from those of k words and the next word
            both = np.unique(both[: len(first) - k] * len(ids) + first[k:], return_inverse=True)[1].astype(np.int64)
        twice = (np.bincount(both) > 1)[both]
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # of bytes: at the six ASCII spaces only
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
def measures(texts: pa.Array) -> pa.Array:
    columns = zip(*map(measure, texts.to_pylist()), strict=True) if len(texts) else [[]] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def failed(m) -> Column:
    """Any rule, those for hosts included; m gives a measure's column by name."""
    return base_failed(m("n_words"), m("n_repeat_words")) | (100 * m("n_symbols") > 10 * m("word_chars")) | (100 * m("n_dup_lines") > 30 * m("n_lines"))


def host_rates(measured: DataFrame, host: str = "host") -> DataFrame:
    """(host, n, failures, rate): shrunk failure rate of each host; measured has the measures' columns."""
    hosts = measured.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(failed(F.col).cast("long")).alias("failures"))
    hosts = written(hosts, "hosts")
    rate = F.col("failures") / F.col("n")
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean = min(max(sums["mean"] or 0.0, 1e-6), 1 - 1e-6)
    # what hosts differ by beyond the chance in rates of n documents
    between = (sums["spread"] or 0.0) - mean * (1 - mean) * (sums["noise"] or 0.0)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    if sums["hosts"] < 2:
        weight = 1.0
    return hosts.withColumn("rate", (F.col("failures") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def rejected_hosts(rates: DataFrame, max_host_rate: float, name: str, host: str = "host") -> DataFrame:
    """(name): hosts that are rejected.  Broadcast up to BROADCAST_ROWS of them, as counted."""
    bad, seen = measured(rates.where(F.col("rate") > max_host_rate).select(F.col(host).alias(name)), "bad-hosts")
    return F.broadcast(bad) if seen["n"] <= BROADCAST_ROWS else bad


def measured_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    batch_limits(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), measures(F.col(text)).alias("m")).select("doc_id", "host", "m.*")


def judge(docs: DataFrame, max_host_rate: float = 0.5, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures and verdicts of every row: doc_id, host, measures, base_failed, kept."""
    measures_of = written(measured_documents(docs, key, text, host), "measures")
    bad = rejected_hosts(host_rates(measures_of), max_host_rate, "bad_host")
    failed_itself = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (
        measures_of.join(bad, F.col("host") == F.col("bad_host"), "left")
        .withColumn("base_failed", failed_itself)
        .withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull())
        .drop("bad_host")
    )


def documents_kept(docs: DataFrame, max_host_rate: float = 0.5, text: str = "text", host: str = "source") -> DataFrame:
    """docs, all columns, without the rows that are rejected.

    The texts are not moved, they are measured twice; only if more than
    BROADCAST_ROWS hosts are rejected are the rows that pass the rules
    themselves joined with them by a shuffle, which Spark can split at hot hosts.
    """
    measures_of = written(measured_documents(docs, host, text, host), "measures")
    name, m = fresh(docs, "bad_host"), fresh(docs, "trawl_m")
    bad = rejected_hosts(host_rates(measures_of), max_host_rate, name)
    kept = docs.withColumn(m, measures(F.col(text))).where(~base_failed(F.col(f"{m}.n_words"), F.col(f"{m}.n_repeat_words"))).drop(m)
    return kept.join(bad, F.col(host) == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same result in SQL.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
x AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS times FROM x),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, 5) t(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines) AS k FROM f WHERE source IS NOT NULL GROUP BY 1),
s AS (SELECT count(*) AS hosts, least(greatest(avg(k / n), 0.000001), 0.999999) AS mean, var_pop(k / n) AS spread, avg(1.0 / n) AS noise FROM h),
p AS (SELECT mean, CASE WHEN hosts < 2 THEN 1.0 WHEN spread - mean * (1 - mean) * noise > 0 THEN least(greatest(mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1, 1.0), 1000000.0) ELSE 1000000.0 END AS weight FROM s),
v AS (SELECT source, (k + mean * weight) / (n + weight) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept FROM f LEFT JOIN v ON f.source = v.source
"""
