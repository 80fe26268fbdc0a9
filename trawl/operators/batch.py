"""The best hits of very many searches at once: a table of searches meets the postings in one join.

Each search's cuts come from the blocks of its terms, as for a single search
(see `blocks`), so common terms bring their best postings only; the few chunks
whose score the unread blocks could still raise are scored whole by a second
equi-join, on term and chunk.  Phrases of several tokens are equi-joined by
their positions, all of them together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from . import inverted
from .blocks import FEW_POSTINGS, Block, cuts
from .blocks import blocks as blocks_of

#: Rows of searches' terms that are sent to all tasks, at most; more meet the postings in a shuffle.
SENT_TERMS = 100_000
#: Chunks, looked at again for the postings of theirs that were not read, whose ids are sent to all tasks, at most.
SENT_CHUNKS = 1_000_000
_CUT = T.StructType([T.StructField("term", T.StringType()), T.StructField("cut", T.IntegerType()), T.StructField("unread", T.DoubleType()), T.StructField("floor", T.DoubleType())])


def _cuts_of(k: int, few: int):
    """An Arrow function: an array of (term, weight, level, n, least, most) of one search to the cuts of its terms."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for each in rows.to_pylist():
            weights, found = {}, {}
            for r in each:
                weights[r["term"]] = r["w"]
                found.setdefault(r["term"], []).append(Block(r["level"], r["n"], r["least"], r["most"]))
            planned = cuts(weights, {t: sorted(b, key=lambda x: -x.level) for t, b in found.items()}, k, few)
            out.append([{"term": t, "cut": planned.levels[t], "unread": planned.unread[t], "floor": planned.floor} for t in weights])
        return pa.array(out, pa.list_(pa.struct([("term", pa.string()), ("cut", pa.int32()), ("unread", pa.float64()), ("floor", pa.float64())])))

    return F.arrow_udf(run, T.ArrayType(_CUT))


def idf(n_docs: Column, with_term: Column) -> Column:
    return inverted.idf(n_docs, with_term)


def phrase_parts(at: DataFrame, terms: DataFrame, stats: DataFrame, phrases: DataFrame) -> DataFrame:
    """(search, chunk_id, part) of phrases (search, phrase array<string>) of several tokens, whole."""
    distinct = phrases.select("phrase").distinct()
    each = distinct.select("phrase", F.size("phrase").alias("length"), F.posexplode("phrase").alias("offset", "token"))
    stands = at.join(each, F.col("term") == F.col("token")).select("phrase", "length", "chunk_id", "in_title", (F.col("at") - F.col("offset")).alias("start"))
    whole = stands.groupBy("phrase", "length", "chunk_id", "in_title", "start").agg(F.count(F.lit(1)).alias("k")).where("k = length")
    hits = whole.groupBy("phrase", "chunk_id").agg(F.count_if("in_title").alias("tf_title"), F.count_if(~F.col("in_title")).alias("tf_text"))
    lengths = terms.select(F.col("term").alias("t"), F.col("chunk_id").alias("c"), "doc_len")
    hits = hits.join(lengths, (F.element_at("phrase", 1) == F.col("t")) & (F.col("chunk_id") == F.col("c")))
    totals = hits.groupBy(F.col("phrase").alias("p")).agg(F.count(F.lit(1)).alias("n_p")).join(F.broadcast(stats)).select("p", idf(F.col("n"), F.col("n_p")).alias("idf"), "avgdl")
    scored = hits.join(totals, F.col("phrase") == F.col("p")).select(F.col("phrase").alias("own"), "chunk_id", (F.col("idf") * inverted.share(F.col("tf_title"), F.col("tf_text"), F.col("doc_len"), F.col("avgdl"))).alias("part"))
    return phrases.join(scored, F.col("phrase") == F.col("own")).select("search", "chunk_id", "part")


def index_of(tokenized: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings, positions, blocks, stats) for `best`, of the tokens asked for and no others: for chunks without a stored index.

    Statistics are those of all chunks.  tokenized, asked: read several times, so both are to be written tables.
    """
    wanted = asked.select(F.explode("phrase").alias("wanted")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_TERMS else wanted
    rows = tokenized.select("chunk_id", "title_tokens", "text_tokens", "doc_len")
    stats = written(inverted.corpus_stats(rows), "corpus_stats")
    terms = written(inverted.postings(rows, stats, wanted), "postings")
    return terms, inverted.positions(rows, wanted), written(blocks_of(terms, stats), "blocks"), stats


def best(terms: DataFrame, at: DataFrame, blocks: DataFrame, stats: DataFrame, asked: DataFrame, k: int, few: int = FEW_POSTINGS) -> DataFrame:
    """(search, chunk_id, bm25, rank): the k best chunks of each search for any of its phrases.

    asked: (search, phrase array<string>), a row for each phrase of tokens; repeated phrases count as often.
    """
    single = asked.where("size(phrase) = 1").groupBy("search", F.element_at("phrase", 1).alias("t")).agg(F.count(F.lit(1)).alias("times"))
    number = single.select("t").distinct().join(blocks.select(F.col("term").alias("b"), "n"), F.col("t") == F.col("b")).groupBy(F.col("t").alias("d")).agg(F.sum("n").alias("df"))
    weighted = number.join(F.broadcast(stats.select(F.col("n").alias("docs")))).select("d", idf(F.col("docs"), F.col("df")).alias("idf"))
    weighted = single.join(weighted, F.col("t") == F.col("d")).select("search", "t", (F.col("times") * F.col("idf")).alias("w"))
    held = weighted.join(blocks, F.col("t") == F.col("term")).groupBy("search").agg(F.collect_list(F.struct("term", "w", "level", "n", "least", "most")).alias("blocks"))
    planned = held.select(F.col("search").alias("s"), F.inline(_cuts_of(k, few)(F.col("blocks")))).withColumnRenamed("term", "c")
    wanted = weighted.join(planned, (F.col("search") == F.col("s")) & (F.col("t") == F.col("c"))).select("search", "t", "w", "cut", "unread", "floor")
    wanted = written(wanted, "searches")  # a row for each term of a search, read several times below
    sent = wanted.count() <= SENT_TERMS
    to_all = F.broadcast if sent else lambda table: table
    average = F.broadcast(stats.select("avgdl"))
    part = inverted.share(F.col("tf_title"), F.col("tf_text"), F.col("doc_len"), F.col("avgdl"))
    lowest = wanted.groupBy(F.col("t").alias("l")).agg(F.min("cut").alias("lowest"))
    read = terms.join(to_all(lowest), (F.col("term") == F.col("l")) & (F.col("level") >= F.col("lowest"))).join(average).select("term", "chunk_id", "level", part.alias("part"))
    if sent:  # a chunk's postings meet before the searches do, so that no pair of a search and a chunk is shuffled
        read = read.repartition("chunk_id")
    parts = read.join(to_all(wanted), (F.col("term") == F.col("t")) & (F.col("level") >= F.col("cut"))).select("search", "chunk_id", (F.col("w") * F.col("part")).alias("part"), "unread")
    phrases = asked.where("size(phrase) > 1")
    if not phrases.isEmpty():
        parts = parts.union(phrase_parts(at, terms, stats, phrases).select("search", "chunk_id", "part", F.lit(0.0)))
    # at least k chunks reach a search's floor: those that cannot, whatever was not read of them, are let go
    limits = wanted.groupBy(F.col("search").alias("r")).agg(F.sum("unread").alias("rest"), F.max("floor").alias("floor"))
    scored = parts.groupBy("search", "chunk_id").agg(F.sum("part").alias("low"), F.sum("unread").alias("known")).join(to_all(limits), F.col("search") == F.col("r"), "left")
    scored = scored.select("search", "chunk_id", "low", (F.col("low") + F.coalesce("rest", F.lit(0.0)) - F.col("known")).alias("high"), F.coalesce("floor", F.lit(0.0)).alias("floor"))
    scored = written(scored.where(F.col("high") >= F.col("floor") * (1 - 1e-9)).drop("floor"), "scored")
    top = inverted.top_ranks(scored, k, [F.round("low", 12).desc(), F.col("chunk_id").asc()])
    last = top.groupBy(F.col("search").alias("of")).agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(0.0).alias("last"))
    possible = scored.join(last, F.col("search") == F.col("of")).where(F.col("high") >= F.col("last") * (1 - 1e-9))
    possible = written(possible.select("search", "chunk_id", "low"), "possible")
    # the postings of those chunks that were not read
    some = possible.select(F.col("chunk_id").alias("some")).distinct()
    near = terms.join(F.broadcast(some), F.col("chunk_id") == F.col("some"), "left_semi") if possible.count() <= SENT_CHUNKS else terms
    missing = possible.select(F.col("search").alias("ps"), F.col("chunk_id").alias("pc")).join(wanted.where("cut > 0"), F.col("ps") == F.col("search"))
    more = near.join(missing, (F.col("term") == F.col("t")) & (F.col("chunk_id") == F.col("pc")) & (F.col("level") < F.col("cut"))).join(average)
    more = more.select(F.col("ps").alias("search"), "chunk_id", (F.col("w") * part).alias("low"))
    whole = possible.union(more).groupBy("search", "chunk_id").agg((-F.sum("low")).alias("bm25"))
    return inverted.top_ranks(whole, k, [F.round("bm25", 12).asc(), F.col("chunk_id").asc()])
