"""Ranked lexical search: impact-ordered postings, score at a time.

A document's share in a term, its impact, is a whole number, so a term's
postings fall into segments of one exact impact.  A search works through its
terms' segments from the greatest contribution down, in waves, and adds them up
by document.  What is left of a term adds its next impact at most; when all that
is left together can bring no unseen document to the k-th score, and only a few
seen ones, the rest of the segments is never read: those few documents get their
whole scores from their own terms, and the best of them are the answer.
Postings are dealt by document, a task's into shards of bounded size, so that a
term that every document has is nowhere in one place; each task keeps its k best
of every search, and those meet.

Searches are taken in blocks of bounded numbers of items and terms, each a pass
over what the documents hold of the block's terms.

Defined results: null texts and texts without a term have no score and do not
count as documents; items without a term, or with none that occurs, get no rows;
texts of any length are read in full, in pieces; repeated documents each have a
rank, repeated items each have their rows; equal scores are ordered by doc_id,
those without one last; an empty table gives no rows; other columns are dropped,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_limits, measured, released, written

#: Items and distinct terms that one pass searches for, at most.
BLOCK_ITEMS, BLOCK_TERMS = 1000, 200_000
#: Documents that a task holds at a time; bytes of a text that are split at a time.
SHARD_DOCS, PIECE_BYTES = 16_384, 1 << 20
#: Each wave goes down to this share of the contribution before.
WAVE = 0.5

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size: runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").translate(_LETTERS) if text else b""
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE_BYTES)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def impact(tf, m):
    """A term's share in a document, from 0 to 1,000,000."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_mark(n, docs: int, total: int):
    return 75 + (25 * n * docs) // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Shard:
    """Documents with their terms both ways: by document, and by term in segments of falling impact."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.term, self.impact = term, impact(tf, m[doc])
        order = np.lexsort((-self.impact, term))
        self.docs, self.falling = doc[order], self.impact[order]
        self.rising = -self.falling
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.n = len(sizes)

    def best(self, asked: dict[int, int], k: int, least: int, wave: float = WAVE) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, postings read): whole scores of all documents that can have the k-th score, and `least` at least; over 0.

        asked: the factor of each term's impacts.
        """
        live = [(t, f) for t, f in asked.items() if f > 0 and self.starts[t] < self.starts[t + 1]]
        if not live:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        total = np.zeros(self.n, np.int64)
        factor = np.array([f for _, f in live])
        at, stop = self.starts[[t for t, _ in live]].copy(), self.starts[[t + 1 for t, _ in live]]
        left = factor * self.falling[at]
        read, floor = 0, least
        level = int(left.max())
        while True:
            level = int(level * wave)
            for i in np.flatnonzero(left > level):
                first, last, f = at[i], stop[i], factor[i]
                # the first posting whose contribution is not over the level: a segment is read whole or not at all
                cut = last if level <= 0 else first + np.searchsorted(self.rising[first:last], -(level // f), side="left")
                total[self.docs[first:cut]] += f * self.falling[first:cut]
                read += int(cut - first)
                at[i], left[i] = cut, f * self.falling[cut] if cut < last else 0
            rest = int(left.sum())
            if self.n > k:
                floor = max(least, int(np.partition(total, self.n - k)[self.n - k]))
            if rest < floor or not rest:
                break  # no document that has not been seen gets there
        found = np.flatnonzero(total + rest >= max(floor, 1))
        return found, total[found] if not rest else self.scores(found, asked), read

    def scores(self, found: np.ndarray, asked: dict[int, int]) -> np.ndarray:
        """Whole scores of documents, from their own terms."""
        sizes = self.ends[found + 1] - self.ends[found]
        at = np.repeat(self.ends[found] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(found) else np.empty(0, np.int64)
        factor = np.zeros(len(self.starts) - 1, np.int64)
        factor[list(asked)] = list(asked.values())
        out = np.zeros(len(found), np.int64)
        np.add.at(out, np.repeat(np.arange(len(found)), sizes), factor[self.term[at]] * self.impact[at])
        return out


def _order(row: tuple) -> tuple:
    score, doc = row
    return -score, doc is None, doc if doc is not None else 0


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """(key, terms with their repeats) of the items, in blocks of bounded size."""
    held: list[tuple[object, Counter]] = []
    distinct = 0
    for r in items.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        counts = Counter(t for piece in terms(r["text"]) for t in piece)
        if not counts:
            continue
        if held and (len(held) >= BLOCK_ITEMS or distinct + len(counts) > BLOCK_TERMS):
            yield held
            held, distinct = [], 0
        held.append((r["key"], counts))
        distinct += len(counts)
    if held:
        yield held


def held_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> tuple[DataFrame, int, int, dict[int, int]]:
    """(doc_id, n, term and tf as numbers) of the documents that have terms, written, with the number of those documents, of all their terms, and of the documents of each term of the vocabulary."""
    spark = docs.sparkSession
    batch_limits(spark)
    known = spark.sparkContext.broadcast(vocabulary)  # at most BLOCK_TERMS, or those of one item
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        get, df, ends = known.value.get, Counter(), None
        for b in batches:
            ends = b.schema.field(0).type
            keep, ns, ts, fs = [], [], [], []
            for i, body in enumerate(b.column(1).to_pylist()):
                n, counts = 0, Counter()
                for piece in terms(body):
                    n += len(piece)
                    counts.update(map(get, piece))
                if not n:
                    continue
                counts.pop(None, None)
                found = sorted(counts)
                df.update(found)
                keep.append(i)
                ns.append(n)
                ts.append(np.array(found, "<i4").tobytes())
                fs.append(np.array([counts[t] for t in found], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(ns, pa.int64()), pa.array(ts, pa.binary()), pa.array(fs, pa.binary()), pa.nulls(len(keep), pa.list_(pa.int32())), pa.nulls(len(keep), pa.list_(pa.int64()))],
                ["doc_id", "n", "term", "tf", "df_term", "df_n"],
            )
        if df:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, ends), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([list(df)], pa.list_(pa.int32())), pa.array([list(df.values())], pa.list_(pa.int64()))],
                ["doc_id", "n", "term", "tf", "df_term", "df_n"],
            )

    rows = docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n long, term binary, tf binary, df_term array<int>, df_n array<long>")
    made, seen = measured(rows, "held-terms", F.count("n").alias("docs"), F.sum("n").alias("total"))
    each = made.where("df_term is not null").select(F.inline(F.arrays_zip("df_term", "df_n"))).groupBy("df_term").agg(F.sum("df_n").alias("df"))
    df = {r["df_term"]: r["df"] for r in each.collect()}  # at most the vocabulary
    return made, seen["docs"] or 0, seen["total"] or 0, df


def search_block(docs: DataFrame, block: list[tuple[object, Counter]], kind: T.DataType, most: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((item_id, rank, doc_id, score), the table it reads) for a block of items."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in block for t in counts}))}
    made, n_docs, total, df = held_terms(docs, vocabulary, key, text)
    weights = {t: weight(n_docs, df[t]) for t in df}
    asked = [{vocabulary[t]: repeats * weights[vocabulary[t]] for t, repeats in counts.items() if vocabulary[t] in weights} for _, counts in block]
    told = spark.sparkContext.broadcast(asked)
    n_terms = len(vocabulary)

    def shard_of(held: list[tuple]) -> tuple[list, Shard]:
        ids = [i for h in held for i in h[0]]
        sizes = np.array([len(t) // 4 for h in held for t in h[2]], np.int64)
        term, tf = (np.frombuffer(b"".join(x for h in held for x in h[j]), "<i4").astype(np.int64) for j in (2, 3))
        return ids, Shard(sizes, term, tf, length_mark(np.array([n for h in held for n in h[1]], np.int64), n_docs, total), n_terms)

    def run(batches):
        best: list[list[tuple]] = [[] for _ in told.value]
        held, rows, ends = [], 0, None

        def search() -> None:
            ids, shard = shard_of(held)
            for own, factors in zip(best, told.value, strict=True):
                found, scores, _ = shard.best(factors, most, own[-1][0] if len(own) == most else 0)
                if len(found):
                    own += zip(scores.tolist(), (ids[i] for i in found.tolist()), strict=True)
                    own.sort(key=_order)
                    del own[most:]

        for b in batches:
            ends = b.schema.field(0).type
            held.append(tuple(b.column(j).to_pylist() for j in range(4)))
            rows += b.num_rows
            if rows >= SHARD_DOCS:
                search()
                held, rows = [], 0
        if rows:
            search()
        if ends is not None:
            flat = [(k, doc, score) for k, own in enumerate(best) for score, doc in own]
            columns = list(zip(*flat, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], ends), pa.array(columns[2], pa.int64())], ["k", "doc_id", "score"])

    doc_kind = made.schema["doc_id"].dataType.simpleString()
    local = made.where("n is not null").select("doc_id", "n", "term", "tf").mapInArrow(run, f"k int, doc_id {doc_kind}, score long")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = local.withColumn("rank", rank).where(F.col("rank") <= most)
    names = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(block)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("item_id", kind)]))
    return top.join(F.broadcast(names), F.col("k") == F.col("i")).select("item_id", "rank", "doc_id", "score"), made


def search(docs: DataFrame, items: DataFrame, most: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of every item."""
    kind, found = items.schema[item_key].dataType, []
    for block in blocks(items, item_key, item_text):
        rows, source = search_block(docs, block, kind, most, key, text)
        found.append(written(rows, "ranked"))
        released(source)
    if not found:
        empty = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[key].dataType), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], empty)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
n AS MATERIALIZED (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
i AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL),
asked AS MATERIALIZED (SELECT k, item_id, term, count(*) AS times FROM (SELECT k, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
m AS (SELECT r, doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM n, g),
s AS (SELECT k, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM asked JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY k, item_id, r, doc_id),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM t WHERE rank <= 20"""
