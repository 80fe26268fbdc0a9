"""Document fingerprints by consistent weighted sampling, in DataFrame code.

A document is a weighted set: its words (between ASCII spaces, lower case), each
with its number of occurrences.  For each of `hashes` samples and each term, a
hash of the term gives r and c, gamma distributed with shape 2, and a uniform
beta.  With weight w, t = floor(ln w / r + beta) and
ln a = ln c - r (t - beta) - r; the term with the least a is the sample.  Two
documents draw the same (term, t) with a probability that equals their
generalised Jaccard similarity, the sum of least over the sum of greatest
weights.  As a is the same only where term and t are, 16 hashed bits of the
least a stand for the sample.  A share of equal samples has the standard error
sqrt(p (1 - p) / hashes) at likeness p: with 64, as the query has, 0.063 at 0.5
and 0.05 at 0.8; with 32, 0.088 and 0.071.

`fingerprints` compares every text with an edited version of itself, whose end
is replaced by the beginning of the next document, and with the next document.
Texts are moved once: rows are dealt to buckets, ranges of (key, hash of the text)
of about `BUCKET_ROWS` rows each, and the first row of a bucket goes to the bucket
before as well, so that every row finds its next one at home.  Words, weights and
samples are then aggregated within the bucket's task.  A key that very many rows
have, or none, is split by the hash; only rows with equal keys and equal texts
stay together.

Defined results: null is an empty text; texts without a word have a fingerprint
of zeros, alike only with each other; texts of any length are read in full; after
the last row comes the first; rows with equal keys are ordered by the hash of
their text, rows without a key come first; repeated rows each have a result; an
empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS

HASHES = 32
#: Samples of the query.
QUERY_HASHES = 64
#: Samples that are drawn together, in one row of an aggregation.
TOGETHER = 4
BUCKET_ROWS = 500
#: Buckets at most, as their order is found in one task; beyond, buckets hold more rows.
MOST_BUCKETS = 1_000_000
#: Rows of a task, about, and tasks at most.
TASK_ROWS, MOST_TASKS = 2000, 100_000
#: Quantiles of the key that buckets are cut from, at most; a power of two.
QUANTILES = 4096
NO_KEY = -(2**63)
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def buckets_of(key: Column, mark: Column, keys: DataFrame, rows: int) -> Column:
    """Bucket number of a row: the quantile of its key, then equal steps within it; of a key that fills several quantiles, equal steps of `mark`.

    The order of buckets is that of (key, mark).  mark: whole numbers from 0 to 2 ** 63; keys: (k), without nulls.
    """
    wanted = max(1, math.ceil(rows / max(BUCKET_ROWS, rows / MOST_BUCKETS)))
    steps, n = math.ceil(wanted / QUANTILES), min(QUANTILES, wanted)
    found = keys.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10 * QUANTILES).alias("q"), F.min("k").alias("low"), F.max("k").alias("high")).first()
    if found["low"] is None:
        return F.lit(0).cast("long")
    quantiles = [found["low"], *(found["q"] if n > 1 else [])]
    cuts = sorted(set(quantiles))
    own = [quantiles.count(c) if quantiles.count(c) > 1 else 0 for c in cuts]  # quantiles that a key fills, if it does
    starts = list(accumulate([0, *(n + 1 for n in own[:-1])]))
    ends = [*(c - 1 for c in cuts[1:]), found["high"]]
    most = 1
    while most < len(cuts):
        most *= 2
    table = F.array(*(F.lit(c).cast("long") for c in cuts + [2**63 - 1] * (most - len(cuts))))
    halves = [most >> i for i in range(1, most.bit_length())]
    at = F.lit(0)
    if halves:  # the last cut that is not above the key
        at = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda p, h: F.when(F.get(table, p + h) <= key, p + h).otherwise(p))

    def bucket(at: Column) -> Column:
        pick = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), at)
        bounded = lambda step, most: F.least(F.greatest(step, F.lit(0).cast("long")), most - 1)
        low, fills = F.get(table, at), pick(own, "long") * steps
        behind = F.floor((key.cast("double") - low.cast("double")) / (pick(ends, "double") - low.cast("double") + 1) * steps)
        split = F.floor(mark.cast("double") * 2.0**-63 * fills)
        step = F.when((key == low) & (fills > 0), bounded(split, fills)).otherwise(fills + bounded(behind, F.lit(steps).cast("long")))
        return (pick(starts, "long") * steps + step).cast("long")

    return F.element_at(F.transform(F.array(at), bucket), 1)  # the place is found once


def uniform(h: Column, low: int, bits: int) -> Column:
    """Bits of a hash, from bit `low` up, as a number between 0 and 1; never either."""
    part = F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << bits) - 1))
    return (part + F.lit(0.5)) * F.lit(2.0**-bits)


def gamma(one: Column, two: Column) -> Column:
    """The sum of two exponential values: gamma distributed with shape 2, both tails whole."""
    return -F.log(one * two)


def sample_of(term: Column, log_weights: list[Column], k: Column) -> list[Column]:
    """ln a of one term in sample k, for each of several weights."""
    g, h = F.xxhash64(k, term), F.xxhash64(term, k)
    r = gamma(uniform(g, 0, 32), uniform(g, 32, 32))
    log_c = F.log(gamma(uniform(h, 0, 24), uniform(h, 24, 24)))
    beta = uniform(h, 48, 16)
    return [log_c - r * (F.floor(w / r + beta) - beta + 1) for w in log_weights]


def bits_of(a: Column) -> Column:
    return F.when(a.isNull(), 0).otherwise(F.xxhash64(a).bitwiseAND(F.lit(0xFFFF))).cast("int")


def hex_of(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long")), 4, "0")), ""))


def likeness(one: Column, two: Column, hashes: int) -> Column:
    return F.size(F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda same: same)) / F.lit(float(hashes))


def fingerprints(docs: DataFrame, hashes: int = HASHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; key: whole numbers."""
    rows_in = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows_in = rows_in.select("doc_id", F.coalesce("doc_id", F.lit(NO_KEY)).alias("k"), F.shiftrightunsigned(F.xxhash64("body"), 1).alias("mark"), "body")
    keys = rows_in.select("k")
    rows = keys.count()
    bucket = buckets_of(F.col("k"), F.col("mark"), keys, rows)
    seen = rows_in.select("k", "mark", bucket.alias("bucket")).groupBy("bucket").agg(F.min(F.struct("k", "mark")).alias("first"))
    # one row for each bucket: which bucket comes before it
    order = Window.orderBy("bucket")
    last = F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = seen.select("first", F.coalesce(F.lag("bucket").over(order), last).alias("before"))
    if rows <= BROADCAST_ROWS * BUCKET_ROWS // 2:
        before = F.broadcast(before)
    dealt = rows_in.withColumn("bucket", bucket).join(before, (F.col("k") == F.col("first.k")) & (F.col("mark") == F.col("first.mark")), "left")
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    away = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"))
    dealt = dealt.select("doc_id", "k", "mark", "body", F.explode(F.when(F.col("before").isNull(), F.array(home)).otherwise(F.array(home, away))).alias("to")).select("doc_id", "k", "mark", "body", "to.*")
    # as many tasks as the rows need, whatever the session's number of shuffle partitions
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, math.ceil(rows / TASK_ROWS)))
    sequence = Window.partitionBy("bucket").orderBy("guest", "k", "mark", "body")
    placed = dealt.repartition(parts, "bucket").withColumn("row", F.row_number().over(sequence)).withColumn("next", F.lead("body").over(sequence))
    chars = F.char_length("body").cast("long")
    changed = F.floor(chars / 4).cast("int")
    edited = F.concat(F.col("body").substr(F.lit(1), chars.cast("int") - changed), F.substring(F.col("next"), 1, changed))
    placed = placed.select("bucket", "row", "doc_id", "guest", "body", chars.alias("chars"), F.when(~F.col("guest"), edited).alias("edited"))
    return _signed(placed, hashes)


def _signed(placed: DataFrame, hashes: int) -> DataFrame:
    """From rows in their buckets to fingerprints.  What is known of a row travels as terms of kinds of its own, from 2 up."""
    digest = F.sha2(F.col("edited"), 256)
    known = [F.col("doc_id"), F.col("guest").cast("long"), F.col("chars"), *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8))]
    none = F.lit(None).cast("string")
    items = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("body").alias("words"), F.lit(None).cast("long").alias("value")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("words"), F.lit(None).cast("long").alias("value")),
        *(F.struct(F.lit(i + 2).alias("kind"), none.alias("words"), v.alias("value")) for i, v in enumerate(known)),
    )
    wide = placed.select("bucket", "row", F.explode(items).alias("x")).select("bucket", "row", "x.*")
    wide = wide.select("bucket", "row", "kind", "value", F.explode(F.split(F.lower(F.coalesce("words", F.lit(""))), SPACES)).alias("word"))
    wide = wide.where("kind > 1 or word <> ''").select(
        "bucket", "row", F.greatest("kind", F.lit(1)).alias("kind"), F.when(F.col("kind") > 1, F.col("value")).otherwise(F.xxhash64("word")).alias("term"), F.when(F.col("kind") == 0, 1).otherwise(0).alias("own")
    )
    terms = wide.groupBy("bucket", "row", "kind", "term").agg(F.sum("own").alias("w0"), (F.count(F.lit(1)) - F.sum("own")).alias("w1"))

    log_weights = [F.when((F.col("kind") == 1) & (F.col(w) > 0), F.log(w)).alias(w) for w in ("w0", "w1")]
    turns = F.when(F.col("kind") == 1, F.array(*map(F.lit, range(-(-hashes // TOGETHER))))).otherwise(F.array(F.lit(-1)))
    terms = terms.select("bucket", "row", "kind", "term", *log_weights, F.explode(turns).alias("turn"))
    samples = []
    for k in range(TOGETHER):
        found = sample_of(F.col("term"), [F.col("w0"), F.col("w1")], F.col("turn") * TOGETHER + k)
        samples += [F.min(a).alias(f"w{i}_{k}") for i, a in enumerate(found)]
    # of a row: one group for each few samples, one for each known value
    groups = terms.groupBy("bucket", "row", "kind", "turn").agg(*samples, F.max("term").alias("value"))
    sampled = [F.array(*(bits_of(F.col(f"w{i}_{k}")) for k in range(TOGETHER))) for i in (0, 1)]
    parts = F.collect_list(F.when(F.col("kind") == 1, F.struct("turn", sampled[0].alias("w0"), sampled[1].alias("w1"))))
    rows = groups.groupBy("bucket", "row").agg(F.sort_array(parts).alias("parts"), *(F.max(F.when(F.col("kind") == i + 2, F.col("value"))).alias(f"v{i}") for i in range(len(known))))
    nothing = F.array_repeat(F.lit(0), hashes)
    signature = [F.when(F.size("parts") == 0, nothing).otherwise(F.slice(F.flatten(F.col(f"parts.{w}")), 1, hashes)) for w in ("w0", "w1")]
    rows = rows.select("bucket", "row", "v0", "v1", "v2", F.concat(*(F.lower(F.lpad(F.hex(f"v{i}"), 8, "0")) for i in range(3, 11))).alias("edited_sha256"), signature[0].alias("own"), signature[1].alias("other"))
    rows = rows.withColumn("following", F.lead("own").over(Window.partitionBy("bucket").orderBy("row"))).where("v1 = 0")
    return rows.select(
        F.col("v0").alias("doc_id"),
        F.col("v2").alias("n_chars"),
        "edited_sha256",
        hex_of(F.col("own")).alias("fingerprint"),
        hex_of(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), hashes).alias("near_edited"),
        likeness(F.col("own"), F.col("following"), hashes).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_HASHES)
